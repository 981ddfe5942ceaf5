"""Surrogates for personal data: keyed, of the same type and format, distinct and consistent corpus-wide.

Only DataFrame functions. Matches and their places come from ``split`` and ``regexp_extract_all``;
surrogates are arithmetic on SHA-256 of key, kind, value and attempt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.functions.scratch import discard, materialize
from zonalis.llm.names import fresh

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_MALE = r"Mr|Herr|Monsieur|Señor|Sr|Господин|Г-н"
_FEMALE = r"Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа|Г-жа"
_EITHER = r"Dr|Prof|Doctor|Professor|Доктор|Профессор"
_TITLE = rf"(?:{_MALE}|{_FEMALE}|{_EITHER}|MR|MRS|MS|MISS|DR|PROF|HERR|FRAU)"
_LETTER = r"[\p{L}\p{M}]"
#: A word of a name: Kern, McDonald, O'Brien, Anna-Maria, SMITH; not the s of a genitive.
_WORD = rf"\p{{Lu}}(?:['’]\p{{Lu}})?{_LETTER}+(?:[-'’](?!s(?!{_LETTER})){_LETTER}+)*(?!{_LETTER})"
#: One pattern per kind; the first that matches at a place counts.
PATTERNS = {
    "email": r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\w.+-])\d{4}(?:[ -]?\d{4}){3}(?![\w-])",
    "ssn": r"(?<![\w.+-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{2,4}\) ?\d{3}[ .-]\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w-])",
    "name": rf"(?<!{_LETTER}){_TITLE}\.? {_WORD}(?: {_WORD})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every match contains: most texts are passed over by this alone.
HINT = rf"[@0-9]|(?<!{_LETTER}){_TITLE}\.? \p{{Lu}}"

#: Syllables of surrogate names, by script: stems, then endings of given names and of surnames by gender.
_SYLLABLES = {
    "latin": (
        ["ba", "be", "bo", "da", "de", "do", "ka", "ke", "ko", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "ra", "re", "ro"],
        {"m": ["ron", "vin", "mir", "bert"], "f": ["lina", "sia", "bella", "tte"], "n": ["ley", "ry", "kim", "lex"]},
        {"n": ["ner", "vak", "lund", "sen"]},
    ),
    "cyrillic": (
        ["ба", "бе", "бо", "ва", "ве", "во", "да", "де", "до", "ка", "ке", "ко", "ла", "ле", "ло", "ма", "ме", "мо", "ра", "ро"],
        {"m": ["рил", "слав", "мир", "тон"], "f": ["лина", "рия", "слава", "ника"], "n": ["ша", "ня", "лик", "жен"]},
        {"m": ["нов", "рин", "ский"], "f": ["нова", "рина", "ская"], "n": ["ко", "енко", "их"]},
    ),
}


def _draw(key: Column, kind: Column, canon: Column, attempt: Column, place: Column) -> Column:
    """A number below 2**32 that only the key's holder can compute."""
    seed = F.concat_ws("\u0001", key, kind, canon, attempt.cast("string"), place.cast("string"))
    return F.conv(F.substring(F.sha2(seed, 256), 1, 8), 16, 10).cast("bigint")


def _pick(number: Column, options: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (number % len(options) + 1).cast("int"))


def _luhn(digits: Column) -> Column:
    """Sum by Luhn's rule of a string of digits; a valid number's is a multiple of ten."""
    n = F.char_length(digits)
    terms = F.transform(F.split(digits, ""), lambda c, i: F.when(
        (n - i) % 2 == 0, F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)
    ).otherwise(c.cast("int")))
    return F.aggregate(terms, F.lit(0), lambda a, b: a + b)


def _mod97(text: Column) -> Column:
    """Remainder by 97 of the number that digits and capital letters (A is 10) spell."""
    digit = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(
        (a * F.when(digit(c) < 10, 10).otherwise(100) + digit(c)) % 97))


def surrogate(key: Column, kind: Column, canon: Column, attempt: Column) -> Column:
    """The surrogate of a canonical value: characters of the same class, with what makes the type valid."""
    draw = lambda place: _draw(key, kind, canon, attempt, place)
    mask = lambda c, i: (
        F.when(c.rlike("[0-9]"), (draw(i) % 10).cast("string"))
        .when(c.rlike("[a-z]"), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (draw(i) % 26 + 1).cast("int"), F.lit(1)))
        .when(c.rlike("[A-Z]"), F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (draw(i) % 26 + 1).cast("int"), F.lit(1)))
        .otherwise(c)
    )
    masked = F.array_join(F.transform(F.split(canon, ""), mask), "")
    keep = lambda n: F.concat(F.substring(canon, 1, n), F.substring(masked, n + 1, 1 << 30))
    domain = F.regexp_extract(canon, r"(\.[^.@]*)$", 1)
    email = F.concat(F.substring(masked, F.lit(1), F.char_length(canon) - F.char_length(domain)), domain)
    # The last digit of a card takes the drawn number to the original's remainder.
    body = F.concat(F.substring(keep(1), 1, 15), F.lit("0"))
    card = F.concat(F.substring(body, 1, 15), F.pmod(_luhn(canon) - _luhn(body), F.lit(10)).cast("string"))
    # The two digits behind an account's country are the check digits of the rest.
    rest = F.substring(masked, 5, 1 << 30)
    country = F.substring(canon, 1, 2)
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(rest, country, F.lit("00")))).cast("string"), 2, "0"), rest)
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i == 0, draw(i) % 223 + 1).otherwise(draw(i) % 256).cast("string")), ".")
    out = (
        F.when(kind == "email", email).when(kind == "card", card).when(kind == "ip", ip)
        .when(kind == "iban", iban).when(kind == "phone", keep(1)).when(kind == "ssn", masked)
    )
    for script, (stems, given, family) in _SYLLABLES.items():
        for part, endings in (("given", given), ("family", family)):
            for gender, ends in endings.items():
                # Each further attempt may be one syllable longer, so there is always a free name.
                stem = F.array_join(F.transform(F.sequence(F.lit(1), attempt + 2), lambda i: _pick(draw(i), stems)), "")
                out = out.when(kind == f"{part} {gender} {script}", F.concat(stem, _pick(draw(F.lit(0)), ends)))
    return out


def _kind(value: Column) -> Column:
    out = F.when(value.rlike(f"^(?:{PATTERNS['email']})$"), "email")
    for kind, pattern in list(PATTERNS.items())[1:]:
        out = out.when(value.rlike(f"^(?:{pattern})$"), kind)
    return out


def _atoms(value: Column) -> Column:
    """What a match refers to, as (kind, canon): one entry, or one per word of a name."""
    kind, words = _kind(value), F.split(value, " ")
    title = F.initcap(F.regexp_replace(words[0], r"\.$", ""))
    gender = F.when(title.rlike(f"^(?:{_MALE})$"), "m").when(title.rlike(f"^(?:{_EITHER})$"), "n").otherwise("f")
    script = lambda w: F.when(w.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    family = F.element_at(words, -1)
    name = F.array(
        F.struct(F.concat_ws(" ", F.lit("given"), gender, script(words[1])).alias("kind"), F.lower(words[1]).alias("canon")),
        F.struct(F.concat_ws(" ", F.lit("family"), F.when(script(family) == "latin", "n").otherwise(gender), script(family)).alias("kind"),
                 F.lower(family).alias("canon")),
    )
    canon = F.when(kind == "email", F.lower(value)).when(kind == "ip", value).otherwise(F.regexp_replace(value, "[^A-Z0-9]", ""))
    return F.when(kind == "name", F.when(F.size(words) == 3, name).otherwise(F.slice(name, 2, 1))).otherwise(
        F.array(F.struct(kind.alias("kind"), canon.alias("canon")))
    )


def _cased(word: Column, name: Column) -> Column:
    """A surrogate name in the letter case of the word that it replaces."""
    return F.when(word == F.upper(word), F.upper(name)).otherwise(F.initcap(name))


def _form(value: Column, found: Column) -> Column:
    """The surrogates ``found`` of a match, written as the match was."""
    first = found[0]
    at = lambda i: F.char_length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), "[^A-Za-z0-9]", ""))
    walked = F.array_join(F.transform(
        F.split(value, ""), lambda c, i: F.when(c.rlike("[A-Za-z0-9]"), F.substring(first, at(i), F.lit(1))).otherwise(c)
    ), "")
    words = F.split(value, " ")
    kind = _kind(value)
    return (
        F.when(kind == "name", F.concat_ws(" ", words[0], F.array_join(F.transform(found, lambda s, i: _cased(words[i + 1], s)), " ")))
        .when(kind == "email", F.when(value == F.upper(value), F.upper(first)).otherwise(first))
        .when(kind == "ip", first).otherwise(walked)
    )


def assign(entities: DataFrame, key: Column) -> DataFrame:
    """(kind, canon, surrogate) of distinct ``entities`` (kind, canon), all different and none an original.

    A surrogate that equals an original value of its kind, or that a smaller value of its kind holds,
    is drawn anew. Every round looks at all values; only the few in conflict change.
    """
    drawn = materialize(entities.withColumn("attempt", F.lit(0)).withColumn(
        "surrogate", surrogate(key, F.col("kind"), F.col("canon"), F.lit(0))
    ))
    while True:
        first = drawn.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canon")).alias("holder"))
        original = drawn.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("taken"))
        marked = drawn.join(first, ["kind", "surrogate"]).join(original, ["kind", "surrogate"], "left").withColumn(
            "bad", F.coalesce("taken", F.lit(False)) | (F.col("holder.canon") != F.col("canon"))
        )
        again = F.col("attempt") + F.col("bad").cast("int")
        redrawn = materialize(marked.select("kind", "canon", again.alias("attempt"), "surrogate", "bad"))
        if redrawn.where("bad").isEmpty():
            return redrawn.select("kind", "canon", "surrogate")
        discard(drawn)
        drawn = materialize(redrawn.select("kind", "canon", "attempt", F.when(
            F.col("bad"), surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt"))
        ).otherwise(F.col("surrogate")).alias("surrogate")))


def _woven(pieces: Column, hits: Column) -> Column:
    """Pieces of a text with what stands between them."""
    return F.array_join(F.transform(
        F.arrays_zip(pieces.alias("p"), hits.alias("h")), lambda x: F.concat(x["p"], F.coalesce(x["h"], F.lit("")))), "")


def _names(hits: Column, found: Column) -> Column:
    """(word, surrogate) of every word of the names among the matches, as written, in capitals and with one."""
    own = F.filter(found, lambda f: f["kind"].rlike("^(given|family) "))
    word = lambda f: F.split(F.element_at(hits, f["hit"] + 1), " ")[F.when(f["kind"].startswith("given"), 1).otherwise(
        F.size(F.split(F.element_at(hits, f["hit"] + 1), " ")) - 1)]
    pair = lambda w, s: F.struct(w.alias("word"), _cased(w, s).alias("surrogate"))
    return F.flatten(F.transform(own, lambda f: F.array(
        *[pair(w, f["surrogate"]) for w in (word(f), F.upper(word(f)), F.initcap(word(f)))])))


def _renamed(piece: Column, known: Column) -> Column:
    """A piece of text with the whole words of known names replaced."""
    quoted = F.array_join(F.transform(known, lambda k: F.concat(F.lit("\\Q"), k["word"], F.lit("\\E"))), "|")
    pattern = F.concat(F.lit(f"(?<!{_LETTER})(?:"), quoted, F.lit(f")(?!{_LETTER})"))
    new = F.transform(F.regexp_extract_all(piece, pattern, F.lit(0)), lambda w: F.filter(known, lambda k: k["word"] == w)[0]["surrogate"])
    return _woven(F.split(piece, pattern, -1), new)


def replace_entities(docs: DataFrame, key: str, text: str = "text", into: str = "n_entities") -> DataFrame:
    """``docs`` with every detected entity in ``text`` replaced by its surrogate, and their number in ``into``.

    Emails, IBANs, card and social security numbers, IP addresses, telephone numbers and names after
    a title are detected; the words of a detected name are replaced wherever else they stand in the
    same text, as they were written, in capitals, or with one capital. A value has one surrogate in the whole table, however it is written (case,
    blanks, separators), so references to it still agree; different values of a kind have different
    surrogates, and none equals a value that occurs. A surrogate keeps length, separators and letter
    case, a card's Luhn remainder, an address's top-level domain, an account's country, with valid check digits, a name's script and its title's
    gender. Another ``key`` gives other surrogates.

    NULL text stays NULL with no entity; texts without one are untouched and not shuffled. Repeated
    rows are replaced alike. All other columns stay (one named like ``into`` is replaced). An empty
    table gives no row.
    """
    pieces, hits, row, found, known = (fresh(docs, n) for n in ("_pieces", "_hits", "_row", "_found", "_known"))
    columns = [c for c in docs.columns if c != into]
    t = F.col(text)
    has = F.coalesce(t.rlike(HINT) & t.rlike(ANY), F.lit(False))
    plain = docs.where(~has).select(*columns, F.lit(0).cast("bigint").alias(into))
    touched = materialize(docs.where(has).select(
        *columns, F.split(t, ANY, -1).alias(pieces), F.regexp_extract_all(t, F.lit(ANY), F.lit(0)).alias(hits),
        F.monotonically_increasing_id().alias(row),
    ))
    used = materialize(touched.select(row, F.posexplode(hits).alias("hit", "value")).select(
        row, "hit", F.posexplode(_atoms(F.col("value"))).alias("part", "atom")
    ).select(row, "hit", "part", "atom.kind", "atom.canon"))
    entities = used.groupBy("kind", "canon").agg(F.lit(1).alias("one")).drop("one")
    named = used.join(assign(entities, F.lit(key)), ["kind", "canon"]).groupBy(row).agg(
        F.sort_array(F.collect_list(F.struct("hit", "part", "surrogate", "kind", "canon"))).alias(found)
    )
    written = F.transform(hits, lambda v, i: _form(v, F.transform(
        F.filter(found, lambda f: f["hit"] == i), lambda f: f["surrogate"]
    )))
    joined = touched.join(named, row).withColumn(known, _names(F.col(hits), F.col(found))).withColumn(
        pieces, F.when(F.size(known) == 0, F.col(pieces)).otherwise(F.transform(pieces, lambda p: _renamed(p, F.col(known))))
    ).withColumn(hits, written)
    rebuilt = _woven(F.col(pieces), F.col(hits))
    return plain.unionByName(joined.select(
        *[rebuilt.alias(c) if c == text else F.col(c) for c in columns], F.size(hits).cast("bigint").alias(into)
    ))

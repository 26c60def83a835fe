"""Surrogates for personal data: keyed, type-consistent replacements, distinct for distinct entities, equal for equal ones."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.llm.common import broadcast_if_small, durable

# Shapes of personal data, and names for surrogates by gender and script.
TITLE = r"(?:Mr|Mrs|Ms|Miss|Sir|Madam|Herr|Frau|Monsieur|Madame|Mme|Se\x{F1}or|Se\x{F1}ora|Sr|Sra|Dr|Prof|\x{413}\x{43E}\x{441}\x{43F}\x{43E}\x{434}\x{438}\x{43D}|\x{413}\x{43E}\x{441}\x{43F}\x{43E}\x{436}\x{430})"
ADDRESS = r"(?:" + TITLE + r"\.? )++"
#: What hex digits after one of these words are: a digest, no secret.
DIGEST = r"(?<!(?i:commit|revision|rev|sha|sha-?1|sha-?256|sha-?512|md5|hash|digest|checksum|etag|blob|tree|parent)[ \t:=#\"'(]{0,4})"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
PATTERNS: dict[str, str] = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)+",
    "key": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}|(?=[0-9a-fA-F]{32})" + DIGEST + r"(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}))(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9A-Za-z.])(?:" + OCTET + r"\.){3}" + OCTET + r"(?!\.?[0-9])",
    "ssn": r"(?<![0-9\-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9\-])",
    "card": r"(?<![0-9\-])(?:[0-9]{13,19}|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,7}|[0-9]{4}(?: [0-9]{4}){2} [0-9]{1,7}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .\-]?\(?[0-9]{2,4}\)?(?:[ .\-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})(?![0-9])",
    "person": r"(?<![\p{L}\p{N}])" + ADDRESS + r"\p{Lu}[\p{L}'\-]++(?: \p{Lu}[\p{L}'\-]++)?+",
}
FEMALE = r"^(?:" + TITLE + r"\.? )*(?:Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Se\x{F1}ora|Sra|\x{413}\x{43E}\x{441}\x{43F}\x{43E}\x{436}\x{430})(?:[. ])"
#: Forms of address that fit every gender; alone they leave it open.
NEUTRAL = r"^(?:(?:Dr|Prof)\.? )+(?!(?:" + TITLE + r")[. ])"
GIVEN = {
    ("latin", "f"): "Alma Beate Clara Doris Elena Frida Greta Helga Irene Julia Karin Laura Maria Nora Olga Paula Rosa Sofia Tilda Vera".split(),
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Kurt Louis Martin Nils Oscar Paul Roman Simon Tomas Victor".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Лидия Мария Нина Ольга Полина Раиса Софья Тамара".split(),
    ("cyrillic", "m"): "Антон Борис Вадим Глеб Денис Егор Захар Иван Кирилл Лев Марк Олег Павел Роман Степан Тимур".split(),
}
GIVEN |= {(script, "n"): GIVEN[script, "f"] + GIVEN[script, "m"] for script in ("latin", "cyrillic")}
FAMILY = {
    "latin": "Abel Berg Castell Dorn Engel Falk Grant Holm Ibsen Jansen Keller Lang Moreau Norden Olsen Prado Quint Reyes Stone Torres Ulrich Vidal Weber Young".split(),
    "cyrillic": "Белый Волк Гром Дуб Ежов Жук Зима Клён Лис Мороз Орёл Пирог Рогоз Снег Туча Ясень".split(),
}

ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity holds: texts without it are not searched further.
HINT = r"[0-9@]|(?=[AMSHFDP\x{413}])(?:AKIA|M(?:r|s|iss|adam|onsieur|me)|S(?:ir|r|e\x{F1}or)|Herr|Frau|Dr|Prof|\x{413}\x{43E}\x{441}\x{43F}\x{43E})|gh[pousr]_|sk-|[a-f]{32}|[A-F]{32}"
#: Digits of the keyed stream for one character, and how many characters it serves before it repeats.
DIGITS, SERVES = 3, 85


def kind_of(surface: Column) -> Column:
    """The type of a found surface: of the first pattern that matches all of it."""
    kinds = list(PATTERNS)
    case = F.lit(kinds[-1])
    for kind in reversed(kinds[:-1]):
        # Look-around needs the text around, which a whole match has not; here it holds at either end.
        case = F.when(surface.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(case)
    return case


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chars(text: Column) -> Column:
    return F.split(text, "")


def luhn_sum(digits: Column) -> Column:
    """The sum of the digits, of which every second one from the right is doubled and cast out of nines; a valid card's ends in 0."""

    def add(total: Column, at: Column) -> Column:
        twice = F.substring(digits, at, F.lit(1)).cast("int") * F.when((F.length(digits) - at) % 2 == 1, 2).otherwise(1)
        return total + F.floor(twice / 10).cast("int") + twice % 10

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def mod_97(signs: Column) -> Column:
    """The number that digits, and letters as 10 to 35, make when written one after the other, modulo 97."""

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(F.upper(c))
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(_chars(signs), F.lit(0), add)


def checked(kind: Column, surface: Column) -> Column:
    """Whether the check digits of a card or IBAN fit; other kinds have none."""
    signs = F.regexp_replace(surface, "[^0-9A-Za-z]", "")
    iban = F.concat(F.substring(signs, 5, 64), F.substring(signs, 1, 4))
    return F.when(kind == "card", luhn_sum(signs) % 10 == 0).when(kind == "iban", mod_97(iban) == 1).otherwise(True)


def names_of(surface: Column) -> Column:
    """A person's names without the form of address and the genitive."""
    return F.regexp_replace(F.regexp_replace(surface, "^" + ADDRESS, ""), "'s$", "")


def repeats(titled: Column) -> Column:
    """A pattern for the names of a text's titled mentions, as they stand there without a title: in full, and the family name."""
    names = F.transform(titled, names_of)
    every = F.array_distinct(F.concat(names, F.transform(names, lambda n: F.substring_index(n, " ", -1))))
    longest = F.array_sort(every, lambda a, b: F.length(b) - F.length(a))
    return F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\p{N}])"))


def same_person(mention: Column, titled: Column) -> Column:
    """The entity of a mention within its text, whose titled mentions' entities are `titled`.

    A family name alone is the first person of that family name who is named in full, one without a gender the first of
    that name who has one; genders that differ are different persons.
    """
    gender, names = F.substring(mention, 1, 1), F.substring(mention, 3, 1 << 20)
    fits = F.filter(titled, lambda e: (F.substring(e, 1, 1) == gender) | (gender == "n") | e.startswith("n:"))
    full = F.filter(fits, lambda e: F.contains(e, F.lit(" ")) & ((F.substring(e, 3, 1 << 20) == names) | F.endswith(e, F.concat(F.lit(" "), names))))
    alone = F.filter(fits, lambda e: F.substring(e, 3, 1 << 20) == names)
    gendered = lambda es: F.filter(es, lambda e: ~e.startswith("n:"))
    return F.coalesce(*(F.try_element_at(es, F.lit(1)) for es in (gendered(full), full, gendered(alone), alone)), mention)


def canonical(kind: Column, surface: Column) -> Column:
    """What mentions of one entity share: letters in lower case and digits only; of a person, gender and names."""
    untitled = ~surface.rlike("^" + ADDRESS)
    gender = F.when(surface.rlike(FEMALE), F.lit("f:")).when(untitled | surface.rlike(NEUTRAL), F.lit("n:")).otherwise(F.lit("m:"))
    person = F.concat(gender, F.lower(names_of(surface)))
    return F.when(kind == "person", person).when(kind.isin("email", "ip"), F.lower(surface)).when(kind == "key", surface).otherwise(F.lower(F.regexp_replace(surface, r"[^\p{L}\p{N}]", "")))


def _stream(key: str, kind: Column, entity: Column, attempt: int) -> Column:
    """256 hex digits that depend on the key, the type, the entity and the attempt."""
    parts = [F.sha2(F.concat_ws("\x1f", F.lit(key), kind, entity, F.lit(str(attempt)), F.lit(half)).cast("binary"), 512) for half in "ab"]
    return F.concat(*parts)


def _pick(stream: str, at: int, values: list[str]) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"element_at(array({listed}), 1 + CAST(CAST(conv(substr({stream}, {1 + DIGITS * at}, 6), 16, 10) AS BIGINT) % {len(values)} AS INT))"


def surrogate(df: DataFrame, key: str, attempt: int) -> DataFrame:
    """Adds `surrogate` to (kind, entity): of the same shape, from the keyed stream of this attempt.

    Letters become letters of their case and script (Latin, Cyrillic, Greek), digits digits, the rest stays. An e-mail
    keeps its last label, an IBAN its country, a card and an international number their first digit; check digits of
    cards and IBANs fit, social security numbers have no part of zeros; octets stay octets of as many digits. Persons get
    names of their gender and script, with a second family name from the third attempt on.
    """
    v = f"CAST(conv(substr(stream, 1 + {DIGITS} * (i % {SERVES}), {DIGITS}), 16, 10) AS INT)"
    hexed = f"CASE WHEN kind = 'key' AND entity RLIKE '^[0-9a-fA-F]+$' THEN true ELSE false END"
    keep = "CASE kind WHEN 'email' THEN length(entity) - length(substring_index(entity, '.', -1)) ELSE 1000000 END"
    start = "CASE kind WHEN 'iban' THEN 4 WHEN 'phone' THEN 1 WHEN 'card' THEN 1 ELSE 0 END"
    chars = f"""array_join(transform(split(entity, ''), (c, i) -> CASE
        WHEN i >= {keep} OR i < {start} THEN c
        WHEN {hexed} AND c RLIKE '[a-f]' THEN substr('abcdef', 1 + {v} % 6, 1)
        WHEN {hexed} AND c RLIKE '[A-F]' THEN substr('ABCDEF', 1 + {v} % 6, 1)
        WHEN kind = 'ssn' AND i IN (0, 3, 5) THEN CAST(1 + {v} % 5 AS STRING)
        WHEN c RLIKE '[0-9]' THEN CAST({v} % 10 AS STRING)
        WHEN c RLIKE '[a-z]' THEN substr('abcdefghijklmnopqrstuvwxyz', 1 + {v} % 26, 1)
        WHEN c RLIKE '[A-Z]' THEN substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 1 + {v} % 26, 1)
        WHEN c RLIKE '\\\\p{{IsCyrillic}}' THEN substr('абвгдежзиклмнопрстуфхцчшщэюя', 1 + {v} % 28, 1)
        WHEN c RLIKE '\\\\p{{IsGreek}}' THEN substr('αβγδεζηθικλμνξοπρστυφχψω', 1 + {v} % 24, 1)
        WHEN c RLIKE '\\\\p{{L}}' THEN substr('abcdefghijklmnopqrstuvwxyz', 1 + {v} % 26, 1)
        ELSE c END), '')"""
    octets = f"""array_join(transform(split(entity, '[.]'), (c, i) -> CAST(CASE length(c) WHEN 1 THEN 1 + {v} % 9 WHEN 2 THEN 10 + {v} % 90 ELSE 100 + {v} % 156 END AS STRING)), '.')"""
    persons = "CASE"
    for script, test in (("cyrillic", "RLIKE '\\\\p{IsCyrillic}'"), ("latin", "IS NOT NULL")):
        for gender in "fmn":
            family = _pick("stream", 10, FAMILY[script]) + (f" || '-' || {_pick('stream', 20, FAMILY[script])}" if attempt >= 2 else "") + (f" || '-' || {_pick('stream', 30, FAMILY[script])}" if attempt >= 5 else "")
            persons += f" WHEN entity {test} AND entity LIKE '{gender}:%' THEN CASE WHEN entity LIKE '% %' THEN {_pick('stream', 0, GIVEN[script, gender])} || ' ' ELSE '' END || {family}"
    persons += " END"
    streamed = df.withColumn("stream", _stream(key, F.col("kind"), F.col("entity"), attempt))
    made = streamed.withColumn("surrogate", F.expr(f"CASE kind WHEN 'ip' THEN {octets} WHEN 'person' THEN {persons} ELSE {chars} END")).drop("stream")
    drawn = F.col("surrogate")
    front = F.expr("substr(surrogate, 1, length(surrogate) - 1)")
    card = F.concat(front, ((10 - luhn_sum(F.concat(front, F.lit("0"))) % 10) % 10).cast("string"))
    country, rest = F.substring(drawn, 1, 2), F.substring(drawn, 5, 64)
    iban = F.concat(country, F.lpad((98 - mod_97(F.concat(rest, country, F.lit("00")))).cast("string"), 2, "0"), rest)
    return made.withColumn("surrogate", F.when(F.col("kind") == "card", card).when(F.col("kind") == "iban", iban).otherwise(drawn))


def sealed(df: DataFrame, key: str) -> DataFrame:
    """durable(df), with its text columns encrypted in the checkpoint folder: what they hold are the personal data."""
    secret = F.unhex(F.lit(hashlib.sha256(f"at rest:{key}".encode()).hexdigest()))
    texts = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    kept = durable(df.select(*(F.aes_encrypt(c, secret).alias(c) if c in texts else F.col(c) for c in df.columns)))
    return kept.select(*(F.aes_decrypt(c, secret).cast("string").alias(c) if c in texts else F.col(c) for c in df.columns))


def distinct_surrogates(entities: DataFrame, key: str, tries: int = 12) -> DataFrame:
    """(kind, entity, surrogate) for distinct (kind, entity): no two entities of a kind share one, none is an entity itself.

    What collides tries again with the next attempt's stream; the smallest entity of those that collide keeps its own.
    After `tries`, which only a shape with fewer values than entities needs, the surrogate gets its entity's digest.
    """
    pending, done = sealed(entities, key), None
    originals = pending.select(F.col("kind").alias("k"), F.when(F.col("kind") == "person", F.substring_index("entity", ":", -1)).otherwise(F.col("entity")).alias("o"))
    for attempt in range(tries):
        tried = surrogate(pending, key, attempt)
        free = tried.join(originals, (F.col("kind") == F.col("k")) & (F.lower("surrogate") == F.lower("o")), "left_anti")
        if done is not None:
            taken = done.select(F.col("kind").alias("k"), F.col("surrogate").alias("s"))
            free = free.join(taken, (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("s")), "left_anti")
        settled = free.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity")).select("kind", "entity", "surrogate")
        done = sealed(settled if done is None else done.unionByName(settled), key)
        rest = pending.join(done.select(F.col("kind").alias("k"), F.col("entity").alias("e")), (F.col("kind") == F.col("k")) & (F.col("entity") == F.col("e")), "left_anti")
        pending = sealed(rest, key)
        if pending.isEmpty():
            return done
    last = surrogate(pending, key, tries).withColumn("surrogate", F.concat("surrogate", F.lit("-"), F.substring(F.sha2(F.concat(F.lit(key), "entity").cast("binary"), 256), 1, 20)))
    return sealed(done.unionByName(last.select("kind", "entity", "surrogate")), key)


def rendered(kind: Column, surface: Column, replacement: Column) -> Column:
    """The surrogate in the surface's format: its separators, its upper case, its form of address."""
    address = F.regexp_extract(surface, f"^({ADDRESS})", 1)
    person = F.concat(address, F.when(F.contains(names_of(surface), F.lit(" ")), replacement).otherwise(F.substring_index(replacement, " ", -1)), F.regexp_extract(surface, "('s)$", 1))
    both = F.struct(F.split(surface, "").alias("chars"), replacement.alias("r"))
    filled = F.aggregate(
        both["chars"],
        F.struct(F.lit("").alias("out"), F.lit(0).alias("used")),
        lambda s, c: F.when(
            c.rlike(r"[\p{L}\p{N}]"),
            F.struct(F.concat(s["out"], F.when(c.rlike(r"\p{Lu}"), F.upper(both["r"].substr(s["used"] + 1, F.lit(1)))).otherwise(both["r"].substr(s["used"] + 1, F.lit(1)))).alias("out"), (s["used"] + 1).alias("used")),
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["used"].alias("used"))),
        lambda s: F.concat(s["out"], F.substring(both["r"], s["used"] + 1, F.lit(64))),
    )
    return F.when(kind == "person", person).when(kind.isin("ip", "key"), replacement).when(kind == "email", F.when(surface.rlike(r"\p{Lu}"), F.upper(replacement)).otherwise(replacement)).otherwise(filled)


def _titled(found: Column) -> Column:
    """The mentions of a text that are persons with a form of address."""
    return F.filter(found, lambda m: m.rlike(f"^(?:{PATTERNS['person']})$"))


def _pattern(titled: Column) -> Column:
    """What is sought in a text with these titled mentions: they may come again without their titles."""
    return F.when(F.size(titled) > 0, F.concat(F.lit(ANY + "|"), repeats(titled))).otherwise(F.lit(ANY))


def _matches(text: Column, pattern: Column) -> Column:
    return F.regexp_extract_all(text, F.concat(F.lit("("), pattern, F.lit(")")), F.lit(1))


def replace_pii(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text", count: str | None = None, tries: int = 12) -> DataFrame:
    """docs with surrogates in place of the personal data in `text`; all other columns and texts stay as they are.

    An entity has one surrogate in all documents, by the key; different entities have different ones, none of which is
    an entity of the corpus. Numbers whose check digits do not fit are no cards or IBANs. Of a person named with a form of
    address, the names without one are mentions too, in full or the family name, and short mentions are the same entity as
    the full one in their text. count: a column to add with the number of mentions replaced. Null and empty texts have
    none; rows with null or repeated ids are rows like any other; an empty table gives no rows; columns may have any names.

    All texts are searched once; texts with mentions, told by their digest, are searched again when they are rewritten.
    The table of what to put is held by every task if it is small, else texts are shuffled by their digest. A mention that
    a third of the texts hold is one row of the table of entities, and its join splits. What is kept on the way is encrypted.
    """
    body = F.col(text)
    digest = F.sha2(body.cast("binary"), 256)
    first = F.when(body.rlike(HINT), F.regexp_extract_all(body, F.lit(f"({ANY})"), F.lit(1)))
    touched = docs.select(digest.alias("k"), body.alias("t"), first.alias("first")).where(F.size("first") > 0).dropDuplicates(["k"])
    titled = touched.select("k", "t", "first", _titled(F.col("first")).alias("titled"))
    found = titled.select("k", "titled", F.when(F.size("titled") > 0, _matches(F.col("t"), _pattern(F.col("titled")))).otherwise(F.col("first")).alias("found"))
    mentions = found.select("k", "titled", F.explode(F.array_distinct("found")).alias("surface"))
    kinds = mentions.withColumn("kind", kind_of(F.col("surface"))).where(checked(F.col("kind"), F.col("surface"))).withColumn("own", canonical(F.col("kind"), F.col("surface")))
    persons = F.transform("titled", lambda m: canonical(F.lit("person"), m))
    entity = F.when(F.col("kind") == "person", same_person(F.col("own"), persons)).otherwise(F.col("own"))
    typed = sealed(kinds.select("k", "surface", "kind", entity.alias("entity")), key)
    entities = distinct_surrogates(typed.select("kind", "entity").distinct(), key, tries).withColumnsRenamed({"kind": "_kind", "entity": "_entity"})
    resolved = typed.join(entities, (F.col("kind") == F.col("_kind")) & (F.col("entity") == F.col("_entity"))).select("k", "surface", rendered(F.col("kind"), F.col("surface"), F.col("surrogate")).alias("put"))
    maps = resolved.groupBy(F.col("k").alias("_k")).agg(F.map_from_entries(F.collect_list(F.struct("surface", "put"))).alias("put"))

    whole = docs.select(F.struct("*").alias("row"), body.alias("t"), digest.alias("k"))  # names of docs' columns clash with none of ours
    joined = whole.join(broadcast_if_small(maps, typed.count()), F.col("k") == F.col("_k"), "left")
    t, put = F.col("t"), F.col("put")

    def put_in(pattern: Column) -> Callable[[Column], Column]:
        def done(surfaces: Column) -> Column:
            pieces = F.transform(F.split(t, pattern, -1), lambda s, i: F.when(i < F.size(surfaces), F.concat(s, F.coalesce(put[F.get(surfaces, i)], F.get(surfaces, i)))).otherwise(s))
            return F.struct(F.array_join(pieces, "").alias("text"), F.size(F.filter(surfaces, lambda m: put[m].isNotNull())).cast("long").alias("n"))

        return done

    def rewritten(first: Column) -> Column:
        def by_titles(titled: Column) -> Column:
            again = _let(_pattern(titled), lambda pattern: _let(_matches(t, pattern), put_in(pattern)))
            return F.when(F.size(titled) == 0, put_in(F.lit(ANY))(first)).otherwise(again)

        return _let(_titled(first), by_titles)

    again = _let(F.regexp_extract_all(t, F.lit(f"({ANY})"), F.lit(1)), rewritten)
    done = joined.select("row", F.when(put.isNull(), F.struct(t.alias("text"), F.lit(0).cast("long").alias("n"))).otherwise(again).alias("done"))
    columns = [F.col("done.text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns]
    return done.select(*columns, *([F.col("done.n").alias(count)] if count else []))

"""Surrogates for personal data, in DataFrame and SQL functions only.

Every detected entity is replaced by a keyed surrogate of its type. The letters and digits of an entity are cut into two
halves; each half moves, place by place, by distances that one digest of key, type and the other half gives (two rounds
of a Feistel network), every place within its own class (digits, small or capital letters, vowels and consonants of
names, the letters of each script). No distance is zero, so every place changes. Separators, length, titles, issuer
digits and key prefixes stay, cards keep a valid check digit, known given names change within their gender, and other
given names after a title with a gender get an ending of that gender. Each step can be undone with the key, so different
entities of a format get different surrogates, and an entity gets the same one in every document (coreference) without a
lookup. A check over all distinct entities finds what may still collide (known and unknown names) or is left unchanged;
those entities alone are moved again under another key. Entities whose halves agree in one half move alike in the other;
whoever must not see that needs a cipher of more rounds.

Numbers that only look like cards (check digit, issuer) or addresses (octets over 255) are left alone.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import prepare, stored

#: Given names by gender (fixed values).
GIVEN = {
    "female": ("Anna", "Clara", "Elena", "Emma", "Eva", "Julia", "Laura", "Lena", "Lucia", "Maria", "Marta", "Nora", "Paula", "Sara", "Sofia", "Alice"),
    "male": ("Adam", "Anton", "Bruno", "Carlos", "Daniel", "David", "Felix", "Hugo", "Jan", "Leon", "Lucas", "Marco", "Martin", "Oscar", "Paul", "Victor"),
}
#: Titles by gender (fixed values); those of no gender last.
TITLES = {
    "female": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra"),
    "male": ("Mr", "Herr", "Monsieur", "Señor", "Sr"),
    "": ("Mx", "Dr", "Prof"),
}
#: What may stand before a secret (fixed values).
KEYWORDS = "password|passwd|pwd|secret|token|api_key|apikey"
KEY = rf"(?i:{KEYWORDS})[\"']{{0,1}}\s{{0,2}}[=:]\s{{0,2}}[\"']{{0,1}}"
TITLE = "(?:" + "|".join(sorted((f for ts in TITLES.values() for t in ts for f in (t, t.upper())), key=lambda t: (-len(t), t))) + ")"
WORD = r"\p{Lu}(?:[\p{Lu}\p{Ll}\p{M}]|['’-](?=[\p{Lu}\p{Ll}]))+"
KNOWN = "(?:" + "|".join(n for names in GIVEN.values() for n in names) + ")"
#: What is detected (fixed patterns), after a character that is not of a word.
PATTERNS = {
    "email": r"(?<![.%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?<!\.)(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<!-)\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-])",
    "ssn": r"(?<!-)\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<!\+)(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3,4}[ .-]?\d{3,4}(?!\w)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w))",
    "secret": r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,255}|sk-[A-Za-z0-9_-]{16,255}|xox[abprs]-[A-Za-z0-9-]{10,255}|[0-9A-Fa-f]{32,128})(?!\w)",
    "name": rf"(?:{TITLE}\.? {WORD}(?: {WORD})?|{KNOWN} {WORD})",
}
#: A value after its keyword; the keyword may follow anything.
KEYED = rf"(?=[pstaPSTA]){KEY}[A-Za-z0-9+/_.=-]{{6,255}}+(?!@)"
def _together(*first: str) -> str:
    """All patterns as one; a look at the first character spares most of them."""
    number, capital = "|".join(PATTERNS[k] for k in ("ip", "card", "ssn", "phone")), "|".join(PATTERNS[k] for k in ("iban", "name"))
    return r"(?<![\w\p{L}])(?:" + "|".join((*first, f"(?=[0-9(+])(?:{number})", f"(?=[A-Z])(?:{capital})", f"(?=[0-9A-Fa-gsx])(?:{PATTERNS['secret']})")) + ")|" + KEYED


PATTERN, WITHOUT_MAIL = _together(PATTERNS["email"]), _together()
#: Parts that stay (fixed patterns): keyword and key prefixes, issuer digit, country of an account, title.
STAYS = {
    "email": r"^", "ip": r"^", "iban": r"^[A-Z]{2}", "card": r"^\d", "ssn": r"^", "phone": r"^(?:\+\d{1,3}(?=[ .(-]))?",
    "secret": rf"^(?:{KEY})?(?:AKIA|gh[pousr]_|sk-|xox[abprs]-)?", "name": rf"^(?:{TITLE}\.? )?",
}
IS_HEX = "^[0-9A-Fa-f]{32,}$"


def _name_letters() -> tuple[str, ...]:
    """Classes of small letters: vowels and consonants of English, then by script all letters that have a capital of
    their own, and last by script those that have none."""
    found: dict[tuple[bool, str], list[str]] = {}
    for c in map(chr, range(0x80, 0x10000)):
        if unicodedata.category(c) == "Ll":
            common = 0xDF <= ord(c) <= 0x17F or 0x3AC <= ord(c) <= 0x3CE or 0x430 <= ord(c) <= 0x44F  # Latin, Greek, Cyrillic of today
            script = unicodedata.name(c).split()[0] + (" common" if common else "")
            found.setdefault((len(c.upper()) != 1 or c.upper() == c or c.upper().lower() != c, script), []).append(c)
    many = {k: v for k, v in found.items() if len(v) > 1}
    rest = [c for k, v in found.items() if len(v) == 1 for c in v]
    return ("aeiou", "bcdfghjklmnpqrstvwxyz", *("".join(v) for _, v in sorted(many.items())), "".join(rest) if len(rest) > 1 else "".join(rest) * 2)


#: Classes of characters that move among themselves.
DIGITS, SMALL, CAPITAL, HEX, NAMES = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef", _name_letters()
#: Endings of given names, by script of the last letter and gender (fixed values).
ENDINGS = {r"\p{IsCyrillic}": ("а", "ий"), r"\p{IsGreek}": ("α", "ος"), r"\p{IsLatin}": ("a", "o")}


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _digest(key: str, kind: Column, attempt: Column, turn: int, other: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"), F.lit(str(turn)), other), 512)


def _number(digest: Column, at: Column | int) -> Column:
    """One of the 32 numbers below 2^16 of a digest; past them they repeat, one larger."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substring(digest, (F.pmod(at, F.lit(32)) * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int") + F.floor(at / 32).cast("int")


def _move(text: Column, digest: Column, classes: tuple[str, ...]) -> Column:
    """Each letter to another one of its class."""
    everything, starts, at = "".join(classes), [], 0
    for c in classes:
        starts.append(at)
        at += len(c)
    bounds = F.expr(f"array({', '.join(map(str, [*starts, at]))})")

    def place(where: Column, i: Column, g: Column) -> Column:
        low = F.array_max(F.filter(bounds, lambda b: b <= where["p"]))
        high = F.array_min(F.filter(bounds, lambda b: b > where["p"]))
        moved = bind(F.struct(low.alias("low"), (high - low).alias("size")), lambda r: r["low"] + F.pmod(where["p"] - r["low"] + 1 + F.pmod(_number(g, i), r["size"] - 1), r["size"]))
        return F.when(where["p"] < 0, where["c"]).otherwise(F.substring(F.lit(everything), (moved + 1).cast("int"), F.lit(1)))

    found = lambda c: F.struct(c.alias("c"), (F.instr(F.lit(everything), c) - 1).alias("p"))
    return bind(digest, lambda g: F.array_join(F.transform(F.transform(_letters(text), found), lambda w, i: place(w, i, g)), ""))


def encipher(text: Column, key: str, kind: Column, attempt: Column, classes: tuple[str, ...] = (DIGITS, SMALL, CAPITAL)) -> Column:
    """Both halves of a text of letters and digits moved; one to one, and no place keeps its letter."""
    def halves(t: Column) -> Column:
        n = F.floor(F.length(t) / 2).cast("int")
        return F.struct(F.substring(t, F.lit(1), n).alias("l"), F.substring(t, n + 1, F.length(t)).alias("r"))

    second = lambda h: _move(h["r"], _digest(key, kind, attempt, 1, h["l"]), classes)
    first = lambda h, r: _move(h["l"], _digest(key, kind, attempt, 2, r), classes)
    return bind(text, lambda t: bind(halves(t), lambda h: bind(second(h), lambda r: F.concat(first(h, r), r))))


def weave(pattern: Column, letters: Column, moving: str) -> Column:
    """pattern with its moving characters replaced by letters, in order; capitals stay capitals."""
    def put(c: Column, i: Column, b: Column) -> Column:
        at = F.length(F.regexp_replace(F.substring(b["p"], F.lit(1), (i + 1).cast("int")), f"[^{moving}]", ""))
        new = F.substring(b["l"], at, F.lit(1))
        large = (c != F.lower(c)) & (F.length(F.upper(new)) == 1)
        return F.when(~c.rlike(f"^[{moving}]$"), c).when(large, F.upper(new)).otherwise(new)

    return bind(F.struct(pattern.alias("p"), letters.alias("l")), lambda b: F.array_join(F.transform(_letters(b["p"]), lambda c, i: put(c, i, b)), ""))


def _in_place(text: Column, moving: str, key: str, kind: Column, attempt: Column, classes: tuple[str, ...], fold: Column) -> Column:
    """The moving characters of a text enciphered where they stand; fold: whatever their case."""
    def run(t: Column) -> Column:
        letters = F.regexp_replace(t, f"[^{moving}]", "")
        return weave(t, encipher(F.when(fold, F.lower(letters)).otherwise(letters), key, kind, attempt, classes), moving)

    return bind(text, run)


def _luhn(digits: Column) -> Column:
    """The check digit for a string of digits."""
    zero = F.struct(F.lit(0).alias("sum"), F.lit(True).alias("twice"))
    def step(a, c):
        d = c.cast("int") * F.when(a["twice"], 2).otherwise(1)
        return F.struct((a["sum"] + d - F.when(d > 9, 9).otherwise(0)).alias("sum"), (~a["twice"]).alias("twice"))
    return F.pmod(-F.aggregate(_letters(F.reverse(digits)), zero, step)["sum"], F.lit(10))


def kind_of(entity: Column) -> Column:
    """The type of a detected entity: the first pattern that it matches alone; null for numbers that only look like one."""
    out = F.when(entity.rlike(rf"^{KEYED}$"), "secret")
    for name, pattern in PATTERNS.items():
        test, kind = entity.rlike(rf"^(?:{pattern})$"), F.lit(name)
        if name == "ip":
            kind = F.when(F.forall(F.split(entity, r"\."), lambda o: o.cast("int") < 256), kind)
        if name == "card":
            digits = F.regexp_replace(entity, r"\D", "")
            valid = digits.rlike("^[2-6]") & (F.right(digits, F.lit(1)) == _luhn(F.regexp_replace(digits, r"\d$", "")).cast("string"))
            kind = F.when(valid, kind).when(digits.rlike(r"^\d{32,}$"), F.lit("secret"))
        out = out.when(test, kind)
    return out.otherwise("secret")


def rest_of(entity: Column, kind: str) -> Column:
    return F.regexp_replace(entity, STAYS[kind], "")


def canonical(entity: Column, kind: Column) -> Column:
    """What makes two mentions the same entity."""
    secret = F.regexp_replace(entity, rf"^(?:{KEY})", "")
    return (
        F.when(kind == "email", F.lower(entity)).when(kind.isin("phone", "card", "ssn"), F.regexp_replace(entity, r"\D", "")).when(kind == "iban", F.regexp_replace(entity, " ", ""))
        .when(kind == "name", F.lower(rest_of(entity, "name"))).when(kind == "ip", F.regexp_replace(entity, r"(?<!\d)0+(?=\d)", "")).when((kind == "secret") & secret.rlike(IS_HEX), F.lower(secret)).otherwise(secret)
    )


def surrogate(entity: Column, kind: Column, key: str, attempt: Column) -> Column:
    # addresses: octets in two halves
    def shift(pair: Column, turn: int, other: Column) -> Column:
        digest = _digest(key, F.lit("ip"), attempt, turn, F.concat_ws(".", other.cast("array<string>")))
        return bind(digest, lambda g: F.transform(pair, lambda o, i: F.pmod(o + 1 + F.pmod(_number(g, i), F.lit(255)), F.lit(256)).cast("int")))

    octets = F.transform(F.split(entity, r"\."), lambda x: x.cast("int"))
    ip = bind(octets, lambda o: bind(shift(F.slice(o, 3, 2), 1, F.slice(o, 1, 2)), lambda r: F.concat_ws(".", F.concat(shift(F.slice(o, 1, 2), 2, r), r).cast("array<string>"))))

    # names: word by word, the first of two as a given name
    title = F.lower(F.regexp_extract(entity, rf"^({TITLE})\.? ", 1))
    gender = {g: title.rlike("^(?:" + "|".join(t.lower() for t in ts) + ")$") for g, ts in TITLES.items() if g}

    def given(word: Column, plain: Column) -> Column:
        """A known name by another one of its gender, others letter by letter with an ending of the title's gender."""
        ending = F.lit("")
        for script, (female, male) in ENDINGS.items():
            ending = F.when(plain.rlike(f"{script}$"), F.when(gender["female"], female).when(gender["male"], male).otherwise("")).otherwise(ending)
        out = F.concat(plain, F.when(word == F.upper(word), F.upper(ending)).otherwise(ending))
        for g, names in GIVEN.items():
            listed, n = F.expr("array('" + "', '".join(names) + "')"), len(names)
            turn = F.pmod(_number(_digest(key, F.lit(g), attempt, 1, F.lit("")), 0), F.lit(n - 1))
            other = F.element_at(listed, F.pmod(F.array_position(listed, word).cast("int") + turn, F.lit(n)).cast("int") + 1)
            out = F.when(~gender["male" if g == "female" else "female"] & F.array_contains(listed, word), other).otherwise(out)
        return out

    def named(words: Column) -> Column:
        def one(word: Column, i: Column) -> Column:
            first = (i == 0) & (F.size(words) > 1)
            plain = _in_place(word, r"\p{Lu}\p{Ll}", key, F.when(first, "given").otherwise("family"), attempt, NAMES, F.lit(True))
            return bind(plain, lambda p: F.when(first, given(word, p)).otherwise(p))

        return F.concat(F.regexp_extract(entity, STAYS["name"], 0), F.array_join(F.transform(words, one), " "))

    name = bind(F.split(rest_of(entity, "name"), " "), named)

    # hexadecimal values whatever their case; digits become letters of the case around them
    def hexed(value: Column) -> Column:
        return bind(encipher(F.lower(value), key, F.lit("hex"), attempt, (HEX,)), lambda h: F.when(value.rlike("[A-F]") & ~value.rlike("[a-f]"), F.upper(h)).otherwise(h))

    # all others in place; a card's last digit follows from the others
    def by_kind(stays: Column) -> Column:
        def rest(value: Column) -> Column:
            open_ = F.when(kind == "card", F.regexp_replace(value, r"\d$", "")).otherwise(value)
            moved = bind(F.concat(stays, _in_place(open_, "A-Za-z0-9", key, kind, attempt, (DIGITS, SMALL, CAPITAL), kind == "email")), lambda m: F.when(kind == "card", F.concat(m, _luhn(F.regexp_replace(m, r"\D", "")).cast("string"))).when(kind == "email", F.concat(m, F.lit(".example"))).otherwise(m))
            return F.when((kind == "secret") & value.rlike(IS_HEX), F.concat(stays, hexed(value))).otherwise(moved)

        return bind(F.substring(entity, F.length(stays) + 1, F.length(entity)), rest)

    stays = F.lit("")
    for k in ("iban", "card", "phone", "secret"):
        stays = F.when(kind == k, F.regexp_extract(entity, STAYS[k], 0)).otherwise(stays)
    return F.when(kind == "ip", ip).when(kind == "name", name).when(kind.isNotNull(), bind(stays, by_kind)).otherwise(entity)


ENTITY = "struct<kind:string,canon:string,surrogate:string>"


def _replace(docs: DataFrame, key: str, attempts: bool) -> DataFrame:
    """docs (row, id, text[, attempt map]) -> row, id, text with surrogates, entities (kind, canon, surrogate)."""
    def one(m: Column) -> Column:
        def known(k: Column) -> Column:
            attempt = F.coalesce(F.element_at("attempts", F.concat(k["kind"], F.lit(":"), k["canon"])), F.lit(0)) if attempts else F.lit(0)
            return F.struct(k["kind"].alias("kind"), k["canon"].alias("canon"), surrogate(m, k["kind"], key, attempt).alias("surrogate"))

        return bind(kind_of(m), lambda kind: bind(F.struct(kind.alias("kind"), canonical(m, kind).alias("canon")), known))

    keep = [c for c in ("row", "id", "text", "attempts") if c in docs.columns]
    mail = F.contains("text", F.lit("@"))
    found = F.when(mail, F.regexp_extract_all("text", F.lit(PATTERN), 0)).otherwise(F.regexp_extract_all("text", F.lit(WITHOUT_MAIL), 0))
    found = docs.select(*keep, found.alias("found"))  # the one scan of every text
    some = F.size("found") > 0
    rows = found.select(*keep, F.when(some, F.split("text", PATTERN, -1)).alias("parts"), F.when(some, F.transform("found", one)).otherwise(F.array().cast(f"array<{ENTITY}>")).alias("entities"))
    pieces = F.flatten(F.transform(F.arrays_zip(F.col("parts").alias("p"), F.col("entities").alias("e")), lambda x: F.array(F.coalesce(x["p"], F.lit("")), F.coalesce(x["e"]["surrogate"], F.lit("")))))
    return rows.select("row", "id", F.when(F.size("entities") > 0, F.array_join(pieces, "")).otherwise(F.col("text")).alias("text"), F.filter("entities", lambda e: e["kind"].isNotNull()).alias("entities"))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", most_attempts: int = 8) -> DataFrame:
    """One row per document: id, text with surrogates, n_entities, kinds (the types found, sorted).

    A null text stays null, texts without entities stay as they are. Repeated rows give equal rows; a null id is kept.
    An empty table gives no rows; other columns are not read. Different entities of one type that share a surrogate, and
    entities that are their own surrogate, are looked for over all documents and moved again; if most_attempts rounds do
    not suffice, it raises.
    """
    spark = docs.sparkSession
    prepare(spark)
    plain = docs.select(F.lit(0).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = stored(_replace(plain, key, False), "surrogates")
    moved = None
    for attempt in range(1, most_attempts + 1):
        known = out.select(F.explode("entities").alias("e")).select("e.kind", "e.canon", canonical(F.col("e.surrogate"), F.col("e.kind")).alias("surrogate")).distinct()
        twice = known.groupBy("kind", "surrogate").agg(F.min("canon").alias("stays"), F.count_distinct("canon").alias("n")).where("n > 1")
        clash = stored(known.join(twice, ["kind", "surrogate"]).where("canon <> stays").select("kind", "canon").unionByName(known.where("surrogate = canon").select("kind", "canon")).distinct(), "clash")
        if not clash.limit(1).count():
            break
        now = clash.withColumn("attempt", F.lit(attempt))
        moved = stored(now if moved is None else moved.unionByName(now).groupBy("kind", "canon").agg(F.max("attempt").alias("attempt")), "moved")
        touched = out.select("id", F.explode("entities").alias("e")).select("id", "e.kind", "e.canon").distinct().join(moved, ["kind", "canon"])
        maps = touched.groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct(F.concat("kind", F.lit(":"), "canon").alias("k"), "attempt"))).alias("attempts"))
        again = _replace(plain.join(maps, plain["id"].eqNullSafe(maps["id"])).select("row", plain["id"], "text", "attempts"), key, True)
        rest = out.join(maps.select(F.col("id").alias("id2")), F.col("id").eqNullSafe(F.col("id2")), "left_anti")
        out = stored(rest.unionByName(again), "surrogates")
    else:
        raise ValueError("surrogates still collide")
    return out.select(F.col("id").alias(id_col), "text", F.size("entities").alias("n_entities"), F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["kind"]))).alias("kinds"))

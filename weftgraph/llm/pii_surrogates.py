"""Surrogates for personal data, in DataFrame functions only.

Entities are found by one pattern; each has a kind and a canonical form (case, separators and country code aside), so
that all mentions of a value share one surrogate. A surname that a document has with a given name or a title is also
found where it stands alone in that document.

A value and its surrogate have one format: digits for digits, letters for letters, octets of as many digits, card
numbers with their issuer digit, IBANs with their country; check digits are worked out anew, and stay wrong where they
were. Within a format a keyed permutation gives the surrogates: a Feistel network over the characters, a shift, and the
network backwards. So different values have different surrogates by construction, and none is its own. Given names go
to given names of the same gender and script by a keyed rotation of the list, surnames to composed surnames of the same
script, drawn by a keyed digest.

Over all distinct values it is checked that no surrogate is itself a value of the data and that no two agree, as drawn
surnames might; those in conflict take another permutation, or a longer surname, until no conflict is left. A format
of which the data hold over an eighth of all possible values is not checked: there a surrogate may be another value of
the data, but still each value has a surrogate of its own. The few that changed come as a literal map while they are at
most ``LITERAL`` rows; beyond that as a join on a hash of the text.

Defined cases: a null text stays null and an empty one empty, with no entities; texts without entities are
unchanged to the last character; equal texts get equal results; rows are treated one by one, so repeated rows and
null doc_ids stay; extra columns stay whatever their names; an empty table gives no rows. An empty key is an error.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import discard, fresh, written

#: Rows of redrawn values in a literal, and how many possible values a format must have for each one in the data to be checked.
LITERAL = 2000
SPARSE = 8
ROUNDS = 4

# Given names by script and gender.
GIVEN = {
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Sandra Ashley Emily Donna Michelle Carol Amanda Melissa Anna Maria Julia Sophie Claire Camille Lucia Elena Ursula Greta".split(),
    ("latin", "m"): "James Robert John Michael David William Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Mark Steven Andrew Kenneth Joshua Kevin Pierre Antoine Carlos Miguel Diego Hans Klaus Stefan Jürgen Lukas".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Татьяна Наталья Ирина Светлана Екатерина Юлия".split(),
    ("cyrillic", "m"): "Иван Алексей Дмитрий Сергей Андрей Михаил Николай Владимир Павел Егор".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Γεωργία Ιωάννα".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Νίκος Κώστας Παναγιώτης Ανδρέας".split(),
}
TITLES = "Mr Mrs Ms Miss Mister Madam Herr Frau Monsieur Madame Señor Señora Signor Signora".split()
_PARTS = {
    "latin": "bar bel cor dan del fal gor hal ken lar mar nor par ros tam vel win zel".split(),
    "cyrillic": "бар бел вол гор дан зор кал лев мир нор пол рад сол тар".split(),
    "greek": "αλ βασ γερ δημ καλ λαμ μαν νικ παπ ραλ σταμ φιλ".split(),
}

_LETTER = r"\p{L}"
_ADDRESS = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_IP = r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\d|\.\d)"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_CARD = r"(?<![\w.])\d(?:[ -]?\d){12,18}(?![\w]|\.\d)"
_SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
_PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]\d{2,4}){1,4}|\+\d{8,15}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)"
_KEY_ID = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
_SECRET_WORDS = ("password", "passwd", "secret", "token", "api_key")
_SECRET_LEAD = rf"(?i:{'|'.join(_SECRET_WORDS)}) {{0,2}}[=:] {{0,2}}\"?"
_SECRET = rf"(?=[apstAPST]){_SECRET_LEAD}[A-Za-z0-9+/_-]{{8,}}"
_names = "|".join(sorted({n for g in GIVEN.values() for n in g}))
# An apostrophe belongs to a surname where two letters follow, so a possessive does not.
_SURNAME = r"\p{Lu}(?:[\p{L}-]+(?:'[\p{L}-]{2,})?|'[\p{L}-]{2,})"
_CAPITAL = r"\p{Lu}(?:\p{Ll}[\p{L}-]*(?:'[\p{L}-]{2,})?|'\p{Lu}[\p{L}-]+)"
_NAME = rf"(?<!{_LETTER})(?:(?:{_names}) {_SURNAME}|(?<=(?:{'|'.join(TITLES)})\.? ){_CAPITAL}(?: {_SURNAME})?)(?!{_LETTER})"
# Alternatives are guarded by what they can start with, so most characters cost one test.
NAMES_ONLY = rf"(?=\p{{Lu}}){_NAME}"
PATTERN = rf"{_ADDRESS}|(?=[0-9+(])(?:{_IP}|{_CARD}|{_SSN}|{_PHONE})|{_SECRET}|(?=\p{{Lu}})(?:{_KEY_ID}|{_IBAN}|{_NAME})"


def _found(text: Column) -> Column:
    """All mentions in order but for bare surnames. Texts in which only names can occur take the shorter pattern, which finds the same there."""
    rich = text.contains("@") | text.contains("AKIA") | text.contains("ASIA") | text.rlike("[0-9]")
    rich = rich | text.rlike(rf"(?=[apstAPST])(?i:{'|'.join(_SECRET_WORDS)})")
    found = F.when(rich, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(NAMES_ONLY), F.lit(0)))
    return F.coalesce(found, F.array().cast("array<string>"))


def _surnames(m: Column) -> Column:
    """The surnames of a mention as they are written; none if it is no name."""
    return F.when(_kind(m) == "NAME", F.filter(F.split(m, " "), lambda w: ~F.array_contains(_given_names(), w))).otherwise(F.array().cast("array<string>"))


def _given_names() -> Column:
    return F.array(*(F.lit(n) for g in GIVEN.values() for n in g))


def with_mentions(docs: DataFrame, mentions: str, pattern: str) -> DataFrame:
    """``docs`` with all mentions in order, and the pattern that finds them: PATTERN, and the surnames of the document."""
    first = fresh(docs, "pii_first")
    rows = docs.withColumn(first, _found(F.col("text")))
    bare = F.array_distinct(F.flatten(F.transform(first, _surnames)))
    own = let(bare, lambda names: F.when(F.size(names) > 0, F.concat(F.lit(PATTERN + rf"|(?<!{_LETTER})(?:"), F.array_join(names, "|"), F.lit(rf")(?!{_LETTER})"))))
    rows = rows.withColumn(pattern, F.when(F.size(first) > 0, own))
    return rows.withColumn(mentions, F.when(F.col(pattern).isNull(), F.col(first)).otherwise(F.regexp_extract_all("text", F.col(pattern), F.lit(0)))).drop(first)


def _kind(m: Column) -> Column:
    whole = lambda p: m.rlike(rf"\A(?:{p})\z")
    digits = F.length(F.regexp_replace(m, r"\D", ""))
    kind = F.when(m.contains("@"), "EMAIL").when(whole(_IP), "IP").when(whole(r"[A-Z]{2}\d{2}[A-Z0-9 ]{11,}"), "IBAN").when(whole(_KEY_ID), "KEY")
    kind = kind.when(whole(_SSN), "SSN").when(whole(r"\d[\d -]+") & (digits >= 13), "CARD").when(whole(r"[+(\d][\d ().+-]+") & m.rlike(r"[ ().+-]"), "PHONE")
    return kind.when(whole(r"\p{Lu}[\p{L}'-]*(?: \p{Lu}[\p{L}'-]+)*") & ~m.rlike(r"\d") & m.rlike(r"\p{Ll}|[^\x00-\x7f]"), "NAME").otherwise("SECRET")


#: Digits of a telephone number at most that tell numbers apart; what stands before them is a country code.
NATIONAL = 10


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _canonical(kind: Column, m: Column) -> Column:
    """The form that all mentions of a value share."""
    return F.when(kind.isin("IP", "KEY"), m).when(kind == "SECRET", F.regexp_replace(m, "^" + _SECRET_LEAD, "")).when(kind == "EMAIL", F.lower(m)).when(kind == "PHONE", F.substring(_digits(m), -NATIONAL, NATIONAL)).otherwise(F.lower(F.regexp_replace(m, r"[^\p{L}\p{N}]", "")))


def items(m: Column) -> Column:
    """Kind and canonical form of what a mention consists of: its surnames, or the whole."""
    names = F.transform(_surnames(m), lambda w: F.struct(F.lit("SURNAME").alias("kind"), F.lower(w).alias("value")))
    return let(_kind(m), lambda k: F.when(k == "NAME", names).otherwise(F.array(F.struct(k.alias("kind"), _canonical(k, m).alias("value")))))


def _number(seed: Column, at: Column | int) -> Column:
    """A number below 65536 from the place ``at`` of a digest's hexadecimal digits, which go round."""
    start = (F.lit(at) if isinstance(at, int) else at) * 3 % 60 + 1
    return F.conv(F.substring(seed, start.cast("int"), 4), 16, 10).cast("int")


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _luhn(digits: Column) -> Column:
    """Sum of Luhn's rule over a string of digits, the last one included; 0 modulo 10 if valid."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    """An IBAN's number modulo 97: letters count from 10, the first four characters go last."""
    moved = F.split(F.upper(F.concat(F.substring(text, 5, 64), F.substring(text, 1, 4))), "")
    return F.aggregate(moved, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.when(c.rlike("[0-9]"), c).otherwise("0").cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _symbols(kind: Column, value: Column) -> Column:
    """What a value consists of: characters or octets ``c`` as numbers ``n`` below ``base``, from ``low`` on; a base of 1 keeps the character."""
    last = F.length(value) - F.length(F.substring_index(value, ".", -1))
    of = lambda c, n, base, low: F.struct(c.alias("c"), n.cast("int").alias("n"), F.lit(base).alias("base"), F.lit(low).alias("low"))

    def octet(o: Column) -> Column:
        n = o.cast("int")
        return F.when(F.length(o) == 3, of(o, n - 100, 156, 100)).when((F.length(o) == 2) & (n > 9), of(o, n - 10, 90, 10)).otherwise(of(o, n, 10, 0))

    def character(c: Column, i: Column) -> Column:
        # An address keeps its last label, a key its first four letters, an account its country, a card its issuer; check digits follow.
        kept = F.when(kind == "EMAIL", i >= last).when(kind == "KEY", i < 4).when(kind == "IBAN", i < 2).when(kind == "CARD", i < 1).otherwise(F.lit(False))
        leading = (i == 0) & kind.isin("PHONE", "SSN")
        n = F.ascii(c)
        digit = F.when(leading & (c == "0"), of(c, F.lit(0), 1, 0)).when(leading, of(c, n - 49, 9, 1)).otherwise(of(c, n - 48, 10, 0))
        check = ((kind == "CARD") & (i == F.length(value) - 1)) | ((kind == "IBAN") & ((i == 2) | (i == 3)))
        return F.when(check, of(F.lit("0"), F.lit(0), 1, 0)).when(kept, of(c, F.lit(0), 1, 0)).when(c.rlike(r"\A[0-9]\z"), digit).when(c.rlike(r"\A[a-z]\z"), of(c, n - 97, 26, 97)).when(c.rlike(r"\A[A-Z]\z"), of(c, n - 65, 26, 65)).otherwise(of(c, F.lit(0), 1, 0))

    return F.when(kind == "IP", F.transform(F.split(value, r"\."), octet)).otherwise(F.transform(F.split(value, ""), character))


def shape(kind: Column, value: Column) -> Column:
    """(format, possible): what all values of a permutation's domain share, and how many there are; drawn kinds have none."""
    symbols = lambda s: F.struct(F.array_join(F.transform(s, lambda x: F.when(x["base"] == 1, x["c"]).otherwise(F.concat(F.lit("\x1e"), x["base"], F.lit("-"), F.length(x["c"])))), "").alias("format"), F.aggregate(s, F.lit(1.0), lambda n, x: n * x["base"]).alias("possible"))
    return let(_symbols(kind, value), symbols)


def _permuted(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The value that a keyed permutation without fixed points gives for one of the same format."""

    def turned(s: Column) -> Column:
        half = F.floor(F.size(s) / 2).cast("int")
        head = F.array_join(F.transform(s, lambda x: F.when(x["base"] == 1, x["c"]).otherwise(F.concat(x["base"], F.lit("-"), F.length(x["c"])))), "\x1e")

        def step(state: Column, r: int, sign: int) -> Column:
            """One half is shifted by a digest of the other."""
            mine = (lambda i: i < half) if r % 2 == 0 else (lambda i: i >= half)
            other = F.array_join(F.when(F.lit(r % 2 == 0), F.slice(state, half + 1, F.size(s))).otherwise(F.slice(state, 1, half)), ",")
            seed = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, head, attempt.cast("string"), F.lit(str(r)), other).cast("binary"), 256)
            return let(seed, lambda d: F.transform(state, lambda n, i: F.when(mine(i), F.pmod(n + F.lit(sign) * _number(d, i), F.get(s, i)["base"])).otherwise(n)))

        def onward(state: Column, steps: list[tuple[int, int]]) -> Column:
            if not steps:
                return F.transform(state, lambda n, i: F.struct(F.get(s, i).alias("s"), n.alias("n")))
            r, sign = steps[0]
            if sign == 0:  # the shift between the networks, which leaves nothing in place
                return let(F.transform(state, lambda n, i: F.pmod(n + 1, F.get(s, i)["base"])), lambda x: onward(x, steps[1:]))
            return let(step(state, r, sign), lambda x: onward(x, steps[1:]))

        forth = [(r, 1) for r in range(ROUNDS)]
        done = onward(F.transform(s, lambda x: x["n"]), [*forth, (0, 0), *((r, -1) for r, _ in reversed(forth))])
        number = lambda x: F.lpad((x["n"] + x["s"]["low"]).cast("string"), F.length(x["s"]["c"]), "0")
        letter = lambda x: F.char(x["n"] + x["s"]["low"])
        text = F.transform(done, lambda x: F.when(x["s"]["base"] == 1, x["s"]["c"]).when(x["s"]["base"] == 26, letter(x)).otherwise(number(x)))
        return F.when(kind == "IP", F.array_join(text, ".")).otherwise(F.array_join(text, ""))

    return let(_symbols(kind, value), turned)


def _check_digit(card: Column) -> Column:
    return F.pmod(F.lit(10) - _luhn(F.concat(F.substring(card, 1, F.length(card) - 1), F.lit("0"))) % 10, F.lit(10))


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The canonical form of the surrogate of a canonical value."""
    return let(F.struct(kind.alias("kind"), value.alias("value"), attempt.alias("attempt")), lambda e: _drawn(e, key))


def _drawn(e: Column, key: str) -> Column:
    kind, value, attempt = e["kind"], e["value"], e["attempt"]

    def card(s: Column) -> Column:
        """With a check digit as right or wrong as it was."""
        off = F.substring(value, -1, 1).cast("int") - _check_digit(value)
        return F.concat(F.substring(s, 1, F.length(s) - 1), F.pmod(_check_digit(s) + off, F.lit(10)).cast("string"))

    def account(s: Column) -> Column:
        proper = F.lpad((F.lit(98) - _mod97(F.concat(F.substring(s, 1, 2), F.lit("00"), F.substring(s, 5, 64)))).cast("string"), 2, "0")
        return F.concat(F.substring(s, 1, 2), F.when(_mod97(value) == 1, proper).otherwise(F.substring(value, 3, 2)), F.substring(s, 5, 64))

    def composed(script: str, end: Column, seed: Column) -> Column:
        """Two parts or three, and one more at each attempt, so room never ends."""
        parts = F.transform(F.sequence(F.lit(0), 1 + F.pmod(_number(seed, 17), F.lit(2)) + attempt), lambda k: _pick(_PARTS[script], _number(seed, k)))
        return F.concat(F.array_join(parts, ""), end)

    def surname(seed: Column) -> Column:
        return F.when(value.rlike(r"\p{IsCyrillic}"), composed("cyrillic", F.when(value.endswith("а"), "ова").otherwise("ов"), seed)).when(value.rlike(r"\p{IsGreek}"), composed("greek", F.lit("ου"), seed)).otherwise(composed("latin", F.lit(""), seed))

    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string")).cast("binary"), 256)
    checked = lambda s: F.when(kind == "CARD", card(s)).when(kind == "IBAN", account(s)).otherwise(s)
    return F.when(kind == "SURNAME", let(digest, surname)).otherwise(let(_permuted(kind, value, attempt, key), checked))


def _written_like(mention: Column, value: Column) -> Column:
    """The surrogate's letters and digits in the places and cases of the mention's; what is left over follows."""

    def placed(chars: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

        def step(acc: Column, c: Column) -> Column:
            following = F.coalesce(F.try_element_at(chars, acc["at"]), F.lit(""))
            cased = F.when(c.rlike(r"\A\p{Lu}\z"), F.upper(following)).otherwise(following)
            slot = c.rlike(r"\A[\p{L}\p{N}]\z")
            return F.struct(F.concat(acc["out"], F.when(slot, cased).otherwise(c)).alias("out"), (acc["at"] + F.when(slot, 1).otherwise(0)).alias("at"))

        done = F.aggregate(F.split(mention, ""), start, step)
        return let(done, lambda x: F.concat(x["out"], F.array_join(F.slice(chars, x["at"], F.size(chars)), "")))

    return let(F.split(value, ""), placed)


def _given(key: str) -> Column:
    """Given names to others of the same list; the rotation by a keyed step makes no two alike and leaves none in place."""
    pairs = []
    for (script, gender), names in GIVEN.items():
        step = int(hashlib.sha256(f"{key}{script}{gender}".encode()).hexdigest(), 16) % (len(names) - 1) + 1
        pairs += [F.lit(x) for k, n in enumerate(names) for x in (n, names[(k + step) % len(names)])]
    return F.create_map(*pairs)


def _initial_caps(word: Column, like: Column) -> Column:
    return F.when(like.rlike(r"\A[^\p{Ll}]{2,}\z"), F.upper(word)).otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1000)))


def replaced(m: Column, attempts, key: str) -> Column:
    """What stands in place of a mention; ``attempts`` gives the attempt of a kind and value."""
    surname, given = F.lit("SURNAME"), _given(key)

    def name(w: Column) -> Column:
        drawn = let(F.lower(w), lambda v: surrogate(surname, v, attempts(surname, v), key))
        return F.coalesce(F.try_element_at(given, w), let(drawn, lambda x: _initial_caps(x, w)))

    def other(e: Column) -> Column:
        drawn = surrogate(e["kind"], e["value"], attempts(e["kind"], e["value"]), key)
        return let(drawn, lambda x: F.when(e["kind"].isin("IP", "KEY"), x).when(e["kind"] == "SECRET", F.concat(F.regexp_extract(m, "^" + _SECRET_LEAD, 0), x)).when(e["kind"] == "EMAIL", _cased(m, x)).when(e["kind"] == "PHONE", _written_like(m, F.concat(F.substring(_digits(m), F.lit(1), F.greatest(F.lit(0), F.length(_digits(m)) - NATIONAL)), x))).otherwise(_written_like(m, x)))

    whole = let(let(_kind(m), lambda k: F.struct(k.alias("kind"), _canonical(k, m).alias("value"))), lambda e: F.when(e["kind"] == "NAME", F.array_join(F.transform(F.split(m, " "), name), " ")).otherwise(other(e)))
    return whole


def _cased(mention: Column, value: Column) -> Column:
    """Character by character in the mention's case."""
    return let(F.split(mention, ""), lambda marks: F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(F.coalesce(F.get(marks, i), F.lit("")).rlike(r"\A\p{Lu}\z"), F.upper(c)).otherwise(c)), ""))


def redrawn(docs: DataFrame, key: str) -> DataFrame:
    """(kind, value, attempt) of the distinct values whose first surrogate was in conflict."""
    name, pattern = fresh(docs, "pii_mentions"), fresh(docs, "pii_pattern")
    found = with_mentions(docs, name, pattern).select(F.explode(F.array_distinct(F.flatten(F.transform(name, items)))).alias("e")).select("e.kind", "e.value")
    values = written(found.distinct(), "values")
    shapes = values.where("kind <> 'SURNAME'").select("kind", "value", shape(F.col("kind"), F.col("value")).alias("f")).select("kind", "value", "f.*")
    crowded = shapes.groupBy("kind", "format").agg(F.count(F.lit(1)).alias("n"), F.first("possible").alias("possible")).where(F.col("possible") < SPARSE * F.col("n"))
    dense = shapes.join(crowded.select("kind", "format"), ["kind", "format"], "left_semi").select("kind", "value")
    known = written(values.join(dense, ["kind", "value"], "left_anti").withColumn("attempt", F.lit(0)), "attempts")
    while True:
        drawn = known.select("kind", "value", "attempt", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key).alias("s"))
        taken = values.select("kind", F.col("value").alias("s"), F.lit(1).alias("original"), F.lit(0).alias("draws"), F.lit(None).cast("struct<attempt:int,value:string>").alias("first"))
        mine = drawn.select("kind", "s", F.lit(0).alias("original"), F.lit(1).alias("draws"), F.struct("attempt", "value").alias("first"))
        bad = taken.unionByName(mine).groupBy("kind", "s").agg(F.max("original").alias("original"), F.sum("draws").alias("draws"), F.min("first").alias("first")).where("draws > 0 AND (original = 1 OR draws > 1)")
        bad = written(bad, "conflicts")
        if bad.isEmpty():
            return known.where("attempt > 0")
        clash = drawn.join(bad, ["kind", "s"]).where("original = 1 OR value <> first.value").select("kind", "value", F.lit(1).alias("again"))
        used, known = known, written(known.join(clash, ["kind", "value"], "left").select("kind", "value", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt")), "attempts")
        discard(used, bad)


def replace_text(docs: DataFrame, key: str, count: str) -> DataFrame:
    """``docs`` with surrogates in ``text``, and a column ``count`` of entities; the other columns stay."""
    if not key:
        raise ValueError("surrogates need a key")
    again = redrawn(docs, key)
    few = again.limit(LITERAL + 1).collect()  # bounded by the limit
    name = lambda kind, value: F.concat_ws("\x1f", kind, value)
    mentions, gaps, pattern, table, text_key = (fresh(docs, x) for x in ("pii_mentions", "pii_gaps", "pii_pattern", "pii_attempts", "pii_text_key"))
    rows = with_mentions(docs, mentions, pattern)
    if not few:
        attempts = lambda kind, value: F.lit(0)
    elif len(few) <= LITERAL:
        literal = F.create_map(*(x for r in few for x in (F.lit(f"{r['kind']}\x1f{r['value']}"), F.lit(r["attempt"]))))
        attempts = lambda kind, value: F.coalesce(F.try_element_at(literal, name(kind, value)), F.lit(0))
    else:
        each = rows.where(F.size(mentions) > 0).select(F.xxhash64("text").alias("k"), F.explode(F.flatten(F.transform(mentions, items))).alias("e")).distinct()
        needed = each.select("k", "e.kind", "e.value").join(again, ["kind", "value"]).groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct(name(F.col("kind"), F.col("value")), "attempt"))).alias(table))
        rows = rows.withColumn(text_key, F.xxhash64("text")).join(needed.withColumnRenamed("k", text_key), text_key, "left").drop(text_key)
        attempts = lambda kind, value: F.coalesce(F.try_element_at(F.col(table), name(kind, value)), F.lit(0))
    rows = rows.withColumn(gaps, F.when(F.size(mentions) > 0, F.split("text", F.coalesce(F.col(pattern), F.lit(PATTERN)), -1)))
    swapped = F.transform(F.col(mentions), lambda m: replaced(m, attempts, key))
    text = F.when(F.size(mentions) > 0, F.array_join(F.zip_with(F.col(gaps), F.concat(swapped, F.array(F.lit(""))), lambda g, s: F.concat(g, s)), "")).otherwise(F.col("text"))
    return rows.select(*(text.alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns), F.size(mentions).alias(count))


def surrogates(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_entities) of every row."""
    return replace_text(docs.select("doc_id", "text"), key, "n_entities")


def clean_documents(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in their texts; a column n_chars follows the new text."""
    found = replace_text(docs, key, fresh(docs, "n_entities")).select(*(f"`{c}`" for c in docs.columns))
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found

r"""Operator 8 [native]: personal data and secrets replaced by surrogates.

Entities are found by one regular expression. A person is found behind a title, by initials, behind words that announce a name, before an address in
brackets, or by a given name of a list that is a parameter; names may be written in capitals and hold particles. In a document with a person every
word that is one of its persons' given or family names is that person too, wherever it stands alone.

Each distinct entity gets a surrogate from a keyed digest: digits for
digits, letters for letters of the same case, the same separators; octets of addresses stay valid, numbers that pass the Luhn check and
valid IBANs still are, names are built from syllables of the entity's script with an ending for its gender, in capitals where the name is. The same
entity gets the same surrogate everywhere (coreference). Surrogates are checked against each other and against all
real entities; where two meet, all but one are drawn again with the next counter, until none is left.

Only entities, the capitalised words of documents with a person, and their places are shuffled by value, and each text once to
meet its replacements. A value that a third of all documents hold is one row of the surrogate table; its
places meet it in an equi-join that adaptive execution can split.

Defined cases: null text stays null with 0 entities; a very long text is read to its end, and no run of capitals, hyphens or dots in it is gone over again and again, as a
name has at most ten parts, an address at most 256 characters before its @ and 126 dots behind it; a text without entities is returned as it is; rows equal in id and text get equal results; extra
columns stay, whatever their names; an empty table gives no rows. A name that documents give different genders has one surrogate each; within a document it has
one. Initials and particles stay. A name gets one more syllable every second draw, so names never run out. What is not settled after
MAX_ATTEMPTS draws in a space of at most MAX_SPACE strings is dealt what is still free there; a space with too few free strings, or a larger one
without success in LAST_ATTEMPT draws, raises ValueError. No surrogate that is taken is ever used.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselark.llm.common import column, discard, documents, let, own_prefix, text_of, written
from tesselark.storage import numbered

MAX_ATTEMPTS, LAST_ATTEMPT, MAX_SPACE = 24, 240, 1 << 24
#: The key of the named query; everywhere else the caller gives one.
QUERY_KEY = "key of op8_pii"

# Titles and given names by gender, words that announce a name, particles, and syllables by script.
MALE_TITLES = "Mr Mister Herr Herrn Señor Sr Don Monsieur Sir Господин".split()
FEMALE_TITLES = "Mrs Ms Miss Frau Señora Señorita Sra Doña Madame Mme Mademoiselle Mlle Lady Госпожа".split()
TITLES = "Dr Prof Professor Doctor Doktor Доктор Профессор".split()
MALE_GIVEN = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Peter George Kevin Brian Edward Hans Klaus Jürgen Wolfgang Stefan "
    "Pierre Jacques Michel Jean Antoine François Carlos José Juan Luis Miguel Pedro Jorge Marco Giovanni Mohammed Ahmed Omar Ali Raj Arjun Wei Hiroshi Ivan Alex Lars Иван Алексей Дмитрий Сергей "
    "Николай Владимир Михаил Андрей"
).split()
FEMALE_GIVEN = (
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Emily Emma Olivia Sophie Anna Julia Ursula Monika Petra Sabine Claire Camille Isabelle "
    "Nathalie Carmen María Lucía Elena Pilar Laura Giulia Fatima Aisha Priya Ananya Mei Yuki Olga Ingrid Анна Мария Елена Ольга Наталья Татьяна Екатерина Ирина"
).split()
CUES = (
    "[Nn]ame:|[Nn]ame is|[Cc]ontact:|[Aa]uthor:|[Ss]igned by|[Ss]igned:|[Ww]ritten by|[Ss]incerely,|[Rr]egards,|[Dd]ear|[Aa]ttn:|ich heiße|Ich heiße|[Gg]rüßen,|m'appelle|[Nn]om :|"
    "[Mm]e llamo|[Nn]ombre:|зовут"
)
PARTICLES = "von van de der den del della di da dos la le ter zu".split()
NOT_NAMES = "The This That These Those It He She We They You In On At And But For If When As Our Your My A An Der Die Das Le La Les El Los Las".split()
ACCENTS = ("áàâäéèêëíìîïóòôöúùûüñçÁÀÂÄÉÈÊËÍÌÎÏÓÒÔÖÚÙÛÜÑÇ", "aaaaeeeeiiiioooouuuuncAAAAEEEEIIIIOOOOUUUUNC")
LATIN = "ba be bo da de do fa fe ga ge ka ke ko la le lo ma me mi mo na ne no pa pe ra re ro sa se so ta te to va ve vi za ze zo".split()
CYRILLIC = "ба бе бо ва ве во га го да де до за зо ка ко ла ле ло ма ме мо на не но па по ра ре ро са се со та те то фа фе".split()

#: A name has at most ten parts joined by hyphens or apostrophes, so that no place of a long run costs more than a few hundred steps. Groups are
#: repeated possessively: a matcher that may go back over a group holds each round on its stack.
HUMP = r"\p{Lu}\p{Ll}+(?:\p{Lu}\p{Ll}+){0,9}+(?!\p{L})"
NAME = rf"(?:\p{{Lu}}[\p{{Ll}}'’]+(?:\p{{Lu}}\p{{Ll}}+){{0,9}}+(?!\p{{L}})(?:[-'’]{HUMP}){{0,9}}+|\p{{Lu}}{{2,}}(?!\p{{L}})(?:-\p{{Lu}}{{2,}}+(?!\p{{L}})){{0,9}}+)"
PARTICLE = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,2}}"
WORD = rf"(?<!\p{{L}}){NAME}"

#: Each kind's expression but persons'. The first that matches at a place wins. A prefixed secret may hold - and _ within; behind a separator it must have
#: a digit or 16 letters in a row, so that sk-some-hyphenated-words is none.
KINDS = {
    "email": r"(?<![\p{L}\p{N}_])[\p{L}\p{N}_][\p{L}\p{N}._%+-]{0,255}+@[\p{L}\p{N}][\p{L}\p{N}-]*(?:\.[\p{L}\p{N}][\p{L}\p{N}-]*+){1,126}+",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?:sk|pk|ghp|xox[bp]|AKIA)(?:[-_](?=[0-9A-Za-z_-]{0,255}?(?:[0-9]|[0-9A-Za-z]{16}))[0-9A-Za-z_-]{15,}[0-9A-Za-z]|[0-9A-Za-z]{16}(?:[0-9A-Za-z_-]*[0-9A-Za-z])?))(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{13,19})(?!\d)",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
}


def _plain(name: str) -> str:
    return name.translate(str.maketrans(*ACCENTS))


@dataclass(frozen=True)
class Names:
    """Given names by gender, and the expressions made from them: spelt as listed, without accents, or in capitals."""

    male: Sequence[str] = field(default_factory=lambda: MALE_GIVEN)
    female: Sequence[str] = field(default_factory=lambda: FEMALE_GIVEN)

    @staticmethod
    def spellings(names: Sequence[str]) -> list[str]:
        each = dict.fromkeys(x for n in names for x in (n, _plain(n)))
        return [*each, *dict.fromkeys(x.upper() for x in each)]

    @cached_property
    def person(self) -> str:
        titles = "|".join(x for t in (*MALE_TITLES, *FEMALE_TITLES, *TITLES) for x in dict.fromkeys((t, t.upper())))
        given = "|".join(self.spellings([*self.male, *self.female]))
        no = rf"(?!(?:{'|'.join(NOT_NAMES)})(?!\p{{L}}))"
        initials = r"(?:\p{Lu}\. ?)"
        ways = (
            rf"(?:{titles})(?!\p{{L}})\.? {initials}{{0,3}}{PARTICLE}{NAME}(?: {initials}{{0,2}}{PARTICLE}{no}{NAME})?",
            rf"(?:{given})(?!\p{{L}}) {initials}{{0,2}}{PARTICLE}{NAME}",
            rf"(?:\p{{Lu}}\. ){{2,3}}{PARTICLE}{no}{NAME}",
            rf"{no}{NAME} \p{{Lu}}\. {PARTICLE}{no}{NAME}",
            rf"(?<=(?<!\p{{L}})(?:{CUES}) ){no}{NAME}(?: {initials}{{0,2}}{PARTICLE}{no}{NAME})?",
            rf"{no}{NAME}(?: {NAME}){{1,2}}(?= ?[<(][^\s<>()@]{{1,64}}@)",
        )
        return rf"(?<!\p{{L}})(?=\p{{Lu}})(?:{'|'.join(ways)})"

    @cached_property
    def any(self) -> str:
        """All kinds. Group references count over the whole expression; card's is the only group there."""
        return "|".join(f"(?:{x})" for x in (*KINDS.values(), self.person))

    @cached_property
    def any_word(self) -> str:
        return f"{self.any}|(?:{WORD})"

    def kind_of(self, match: Column) -> Column:
        """The kind of a match, null for a word alone. A person's expression looks around a match, so it is what no other kind is and has two words."""
        known = reduce(lambda rest, k: F.when(match.rlike(f"^(?:{KINDS[k]})$"), F.lit(k)).otherwise(rest), reversed(list(KINDS)), F.lit(None).cast("string"))
        return F.coalesce(known, F.when(match.contains(" "), F.lit("person")))

    def parts_of(self, match: Column) -> Column:
        """A person's match as head (title, initials), given, middle, family (given and middle may be empty) and the given name's gender."""
        titles = "|".join(x for t in (*MALE_TITLES, *FEMALE_TITLES, *TITLES) for x in (t, t.upper()))
        head = F.regexp_extract(match, rf"^((?:(?:{titles})(?!\p{{L}})\.? )?(?:\p{{Lu}}\. ?)*{PARTICLE})", 1)
        body = F.substring(match, F.length(head) + 1, F.length(match))
        given, family = F.regexp_extract(body, rf"^({NAME}) ", 1), F.regexp_extract(body, rf"({NAME})$", 1)
        middle = F.substring(body, F.length(given) + 1, F.length(body) - F.length(given) - F.length(family))
        title = F.initcap(F.regexp_extract(match, r"^(\p{L}+)\.? ", 1))
        listed = lambda names: F.initcap(given).isin(self.spellings(names))
        male, female = title.isin(MALE_TITLES) | listed(self.male), title.isin(FEMALE_TITLES) | listed(self.female)
        gender = F.when(title.isin(FEMALE_TITLES), "f").when(male, "m").when(female, "f").otherwise("n")
        return F.struct(head.alias("head"), given.alias("given"), middle.alias("middle"), family.alias("family"), gender.alias("gender"))


def script_of(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "c").otherwise("l")


def same_case(surrogate_: Column, like: Column) -> Column:
    """A name's surrogate in capitals where the name is."""
    return F.when((F.length(like) > 1) & (F.upper(like) == like), F.upper(surrogate_)).otherwise(surrogate_)


def _number(digest: Column, i: Column) -> Column:
    """A number below 65536 from four of the digest's 128 hexadecimal characters, by place."""
    return F.conv(F.substring(digest, F.pmod(i * 4, F.lit(124)) + 1, F.lit(4)), 16, 10).cast("int")


def _characters(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def _alike(value: Column, number) -> Column:
    """Characters of the same class: digits, hexadecimal letters in hexadecimal strings, letters by case; others stay. number(i) picks the i-th."""
    hexadecimal = value.rlike("^[0-9a-fA-F]+$")
    pick = lambda letters, n: F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1))

    def one(c: Column, i: Column, hexadecimal: Column) -> Column:
        n = number(i)
        low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        return (
            F.when(c.rlike("[0-9]"), pick("0123456789", n))
            .when(hexadecimal & c.rlike("[a-f]"), pick("abcdef", n)).when(hexadecimal & c.rlike("[A-F]"), pick("ABCDEF", n))
            .when(c.rlike(r"\p{Lu}"), pick(up, n)).when(c.rlike(r"\p{L}"), pick(low, n)).otherwise(c)
        )

    return let(hexadecimal, lambda h: F.array_join(F.transform(_characters(value), lambda c, i: one(c, i, h)), ""))


def _luhn_sum(digits: Column) -> Column:
    """Sum of the Luhn check over an array of digits, the last one not doubled."""
    n = F.size(digits)
    doubled = lambda d, i: F.when((n - i) % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    return F.aggregate(F.transform(digits, doubled), F.lit(0), lambda a, x: a + x)


def _digits(value: Column) -> Column:
    return F.transform(F.filter(F.split(value, ""), lambda c: c.rlike("[0-9]")), lambda c: c.cast("int"))


def _card(value: Column, digest: Column) -> Column:
    other = _alike(value, lambda i: _number(digest, i))
    head = F.substring(other, F.lit(1), F.length(other) - 1)
    check = (10 - let(_digits(F.concat(head, F.lit("0"))), _luhn_sum) % 10) % 10
    return F.when(let(_digits(value), _luhn_sum) % 10 == 0, F.concat(head, check.cast("string"))).otherwise(other)


def _iban(value: Column, digest: Column) -> Column:
    """An IBAN of the same country and form; of a valid one the check digits are set, which are 98 less the rest modulo 97 with 00 in their place."""

    def modulo(iban: Column) -> Column:
        bare = F.regexp_replace(iban, "[^0-9A-Z]", "")
        turned = _characters(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4)))
        return F.aggregate(turned, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97)

    other = F.concat(F.substring(value, 1, 2), F.lit("00"), F.substring(_alike(value, lambda i: _number(digest, i)), F.lit(5), F.length(value)))
    check = F.lpad((98 - modulo(other)).cast("string"), 2, "0")
    drawn = F.substring(_alike(value, lambda i: _number(digest, i)), 3, 2)
    return F.concat(F.substring(value, 1, 2), F.when(modulo(value) == 1, check).otherwise(drawn), F.substring(other, F.lit(5), F.length(other)))


def _name(kind: Column, digest: Column, attempt: Column) -> Column:
    cyrillic = kind.endswith("c")
    syllables = F.transform(
        F.sequence(F.lit(0), F.least(F.floor(attempt / 2).cast("int") + 2, F.lit(30))),
        lambda i: F.when(cyrillic, F.get(F.array(*map(F.lit, CYRILLIC)), _number(digest, i) % len(CYRILLIC))).otherwise(F.get(F.array(*map(F.lit, LATIN)), _number(digest, i) % len(LATIN))),
    )
    male, female = F.substring(kind, -2, 1) == "m", F.substring(kind, -2, 1) == "f"
    end = F.when(male, F.when(cyrillic, "н").otherwise("n")).when(female, F.when(cyrillic, "я").otherwise("lia")).otherwise(F.when(cyrillic, "р").otherwise("r"))
    return F.initcap(F.concat(F.array_join(syllables, ""), end))


def _kept_apart(kind: Column, value: Column) -> tuple[Column, Column, Column]:
    """What stays before, what is drawn, and what stays after: an e-mail's last label and a phone's country code stay."""
    mail, code = r"^(.*)(\.[^.]*)$", F.regexp_extract(value, r"^(\+\d{1,3}(?=[ .(-])|)", 1)
    head = F.when(kind == "phone", code).otherwise("")
    tail = F.when(kind == "email", F.regexp_extract(value, mail, 2)).otherwise("")
    return head, F.when(kind == "email", F.regexp_extract(value, mail, 1)).otherwise(F.substring(value, F.length(head) + 1, F.length(value))), tail


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The attempt-th surrogate of an entity."""
    seed = F.concat_ws("\x00", F.lit(key), kind, value, attempt.cast("string")).cast("binary")
    return let(F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit(b"+")), 256)), lambda digest: _drawn(kind, value, attempt, digest))


def _drawn(kind: Column, value: Column, attempt: Column, digest: Column) -> Column:
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_number(digest, i) % 254 + 1).cast("string")), ".")
    head, middle, tail = _kept_apart(kind, value)
    return (
        F.when(kind == "ip", octets).when(kind == "card", _card(value, digest)).when(kind == "iban", _iban(value, digest)).when(kind.startswith("given") | kind.startswith("family"), _name(kind, digest, attempt))
        .otherwise(F.concat(head, _alike(middle, lambda i: _number(digest, i)), tail))
    )


def _free_rest(pending: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """kind, value, surrogate of the e-mails, phone and social security numbers in pending whose space has at most MAX_SPACE strings: each
    space is listed once, what is taken is left out, and the rest dealt in keyed order. Raises ValueError if it does not suffice."""
    head, middle, tail = _kept_apart(F.col("kind"), F.col("value"))
    radix = lambda c: F.when(c.rlike("[0-9]"), 10).when(c.rlike(r"\p{L}"), 26).otherwise(1)
    size = F.aggregate(F.transform(_characters(middle), radix), F.lit(1.0), lambda a, r: a * r)
    small = pending.where(F.col("kind").isin("email", "phone", "ssn")).select("kind", "value", head.alias("head"), _alike(middle, lambda i: F.lit(0)).alias("zero"), tail.alias("tail"), size.alias("size"))
    small = written(small.where(F.col("size") <= MAX_SPACE).withColumn("space", F.concat_ws("\x00", "head", "zero", "tail")))
    strides = F.aggregate(F.transform(_characters(F.col("zero")), radix), F.array(F.lit(1)), lambda a, r: F.array_append(a, F.element_at(a, -1) * r))
    spaces = small.select("space", "head", "zero", "tail", "size").distinct().withColumn("strides", strides)
    places = spaces.select("*", F.explode(F.sequence(F.lit(0), F.col("size").cast("int") - 1)).alias("x"))
    listed = places.select("space", F.concat("head", _alike(F.col("zero"), lambda i: F.floor(F.col("x") / F.get("strides", i)).cast("int")), "tail").alias("surrogate"))
    free = listed.join(taken, "surrogate", "left_anti").withColumn("order", F.sha2(F.concat_ws("\x00", F.lit(key), "surrogate"), 256))

    def dealt(df: DataFrame, order: list[str]) -> DataFrame:
        rows = numbered(df, order, "n")
        return rows.join(rows.groupBy("space").agg(F.min("n").alias("least")), "space").withColumn("n", F.col("n") - F.col("least")).drop("least")

    mine = dealt(small.select("space", "kind", "value"), ["space", "kind", "value"])
    out = written(mine.join(dealt(free, ["space", "order", "surrogate"]), ["space", "n"], "left").select("kind", "value", "surrogate"))
    lost = out.where("surrogate is null").groupBy("kind").count().collect()
    if lost:
        raise ValueError(f"no free surrogates are left for {sorted((r['kind'], r['count']) for r in lost)}: the spaces of these entities are full")
    return out


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """kind, value, surrogate for distinct (kind, value): no two of equal surrogates, none equal to a real value."""
    real = written(entities.distinct())
    done, pending, attempt = [], real, 0
    while not pending.isEmpty():
        taken = real.select(F.col("value").alias("surrogate")).distinct()
        taken = reduce(DataFrame.unionByName, [t.select("surrogate") for t in done], taken).distinct()
        if attempt == MAX_ATTEMPTS:
            done.append(_free_rest(pending, taken, key))
            pending = written(pending.join(done[-1], ["kind", "value"], "left_anti"))
        elif attempt == LAST_ATTEMPT:
            raise ValueError(f"no free surrogates were found in {attempt} draws for {sorted((r['kind'], r['count']) for r in pending.groupBy('kind').count().collect())}")
        else:
            drawn = pending.select("kind", "value", surrogate(F.col("kind"), F.col("value"), F.lit(attempt), key).alias("surrogate"))
            first = F.row_number().over(Window.partitionBy("surrogate").orderBy("kind", "value")) == 1
            drawn = written(drawn.withColumn("first", first).join(taken.withColumn("taken", F.lit(True)), "surrogate", "left").withColumn("free", F.col("first") & F.col("taken").isNull()))
            done.append(drawn.where("free").select("kind", "value", "surrogate"))
            pending = drawn.where(~F.col("free")).select("kind", "value")
        attempt += 1
    return reduce(DataFrame.unionByName, done, real.limit(0).select("kind", "value", F.col("value").alias("surrogate")))


def _places(tokens: DataFrame, names: Names) -> DataFrame:
    """tokens (id, row, at, match, k: kind or null) to id, row, at, part (head and middle strings too), kind, value, raw: what each match consists of. value is
    the entity, raw how it is written; strings that stay have no kind."""
    own = ["id", "row", "at"]
    fixed = lambda part, raw: F.struct(F.lit(part).alias("part"), F.lit(None).cast("string").alias("base"), F.lit(None).cast("string").alias("kind"), raw.alias("raw"))
    name = lambda part, base, gender, raw: F.struct(F.lit(part).alias("part"), F.lit(base).alias("base"), F.concat(F.lit(f"{base}:"), gender, script_of(raw)).alias("kind"), raw.alias("raw"))
    people = tokens.where("k = 'person'").select(*own, names.parts_of(F.col("match")).alias("p"))
    parts = F.array(
        fixed(0, F.col("p.head")), name(1, "given", F.col("p.gender"), F.col("p.given")), fixed(2, F.col("p.middle")), name(3, "family", F.lit("n"), F.col("p.family"))
    )
    parts = people.select(*own, F.explode(parts).alias("x")).select(*own, "x.*").where("raw <> ''").withColumn("value", F.initcap("raw"))
    parts = written(parts)
    # within a document a name has one kind: of several genders the first that is known (f, m, n)
    known = parts.where("kind is not null").groupBy("id", "row", "base", "value").agg(F.min("kind").alias("kind"))
    known = written(known)
    people = parts.drop("kind").join(known, ["id", "row", "base", "value"], "left").select(*own, "part", "kind", "value", "raw")
    alone = known.groupBy("id", "row", "value").agg(F.min(F.struct("base", "kind")).alias("x")).select("id", "row", "value", "x.kind")
    words = tokens.where("k is null").select(*own, F.lit(0).alias("part"), F.initcap("match").alias("value"), F.col("match").alias("raw"))
    words = words.join(alone, ["id", "row", "value"], "left").select(*own, "part", "kind", "value", "raw")
    others = tokens.where("k <> 'person'").select(*own, F.lit(0).alias("part"), F.col("k").alias("kind"), F.col("match").alias("value"), F.col("match").alias("raw"))
    out = written(people.unionByName(words).unionByName(others))
    discard(parts, known)
    return out


def replace_entities(docs: DataFrame, key: str, names: Names | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with surrogates in their texts and, as last column, <prefix>entities, how many were replaced; the prefix is own_prefix(docs)."""
    names, p, text = names or Names(), own_prefix(docs), text_of(text_col)
    own = [F.coalesce(column(id_col).cast("string"), F.lit("null")), F.xxhash64(text)]
    all_of = lambda expression: F.regexp_extract_all(text, F.lit(expression), F.lit(0))
    # a text with a person is read once more, with its capitalised words
    wide = lambda m: F.exists(m, lambda x: names.kind_of(x) == "person")
    read = let(all_of(names.any), lambda m: F.when(wide(m), F.struct(F.lit(True).alias("wide"), all_of(names.any_word).alias("m"))).otherwise(F.struct(F.lit(False).alias("wide"), m.alias("m"))))
    found = docs.select(own[0].alias("id"), own[1].alias("row"), read.alias("r")).where(F.size("r.m") > 0)
    found = found.select("id", "row", F.col("r.wide").alias("wide"), F.posexplode("r.m").alias("at", "match")).distinct()
    tokens = written(found.withColumn("k", names.kind_of(F.col("match"))))
    places = _places(tokens, names)
    table = surrogate_table(places.where("kind is not null").select("kind", "value"), key)
    new = places.join(table, ["kind", "value"], "left").withColumn("new", F.coalesce(same_case(F.col("surrogate"), F.col("raw")), "raw"))
    by_name = F.col("kind").startswith("given") | F.col("kind").startswith("family")
    new = new.withColumn("new", F.when(by_name, F.col("new")).otherwise(F.coalesce("surrogate", "raw")))
    per_match = new.groupBy("id", "row", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "new"))), lambda x: x["new"]), "").alias("new"), F.max(F.col("kind").isNotNull()).alias("hit"))
    per_row = per_match.groupBy("id", "row").agg(F.array_sort(F.collect_list(F.struct("at", "new"))).alias(f"{p}new"), F.sum(F.col("hit").cast("long")).alias(f"{p}hits"))
    flags = tokens.groupBy("id", "row").agg(F.max("wide").alias(f"{p}wide"))
    per_row = written(per_row.join(flags, ["id", "row"]).where(f"{p}hits > 0").withColumnsRenamed({"id": f"{p}id", "row": f"{p}row"}))
    discard(tokens, places)
    joined = docs.withColumns({f"{p}id": own[0], f"{p}row": own[1]}).join(per_row.hint("merge"), [f"{p}id", f"{p}row"], "left")
    fill = lambda expression: let(F.col(f"{p}new"), lambda new: F.array_join(F.transform(F.split(text, expression, -1), lambda g, i: F.concat(g, F.coalesce(F.get(new, i)["new"], F.lit("")))), ""))
    filled = F.when(F.col(f"{p}wide"), fill(names.any_word)).otherwise(fill(names.any))
    return joined.select(
        *(F.when(F.col(f"{p}new").isNull(), column(c)).otherwise(filled).alias(c) if c == text_col else column(c) for c in docs.columns),
        F.coalesce(f"{p}hits", F.lit(0).cast("long")).alias(f"{p}entities"),
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replace_entities(documents(spark, sf_dir).select("doc_id", "text"), QUERY_KEY)
    return out.withColumnRenamed(out.columns[-1], "n_entities")

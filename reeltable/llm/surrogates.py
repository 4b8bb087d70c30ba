"""PII surrogates: each detected entity gets a keyed replacement of its own type, script, gender and format.

An entity's canonical form (an e-mail address in lower case, a number's digits, each part of a name) and a secret key give
its surrogate by HMAC, so that all mentions of an entity, in whatever format, change alike in all documents. An address's
domain is an entity of its own, so that colleagues stay colleagues. The surrogate takes the mention's format: separators,
case, length, country code, card brand and check digit stay. A name's gender comes from titles and given names wherever
they stand in the corpus: "Dr Anna" is the "Mrs Anna" of another document, and both change alike.

Surrogates are checked over the whole corpus as they are printed: of entities with one surrogate the first keeps it, and
a surrogate that is itself an entity of the corpus goes; both are drawn again. From the WIDE-th draw on surrogates grow by
random characters (an IPv4 address becomes an IPv6 one of the range for documentation), so even where all forms of a
length are taken the draws end: the last adds over 2^60 forms to each, and ROUNDS bounds them. What isn't as its place
alone tells (a later draw, a gender from elsewhere) is a small table that is joined to the documents concerned.

Defined results: a null text stays null, an empty one empty; documents without entities keep their texts to the byte.
Repeated rows, and rows that repeat a doc_id, change each by its own text. Very long texts are read whole, pattern by
pattern. Ties go to the entity that sorts first. Empty tables and extra columns pass through.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from reeltable.llm.common import carried, own_names, table, written

#: Where a session names its key, and what the registered query takes for synthetic tables if it names none.
KEY_SETTING, TABLES_KEY = "spark.reeltable.surrogate.key", b"for synthetic tables only"
WIDE, ROUNDS = 4, 12
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "г-н"), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "г-жа"),
    "": ("Dr", "Prof"),
}
#: Given names that tell a person, and a gender, without a title.
GIVEN = {
    "m": "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Paul Andrew Peter George Edward Henry Hans Klaus Jürgen Stefan Wolfgang Pierre Jacques Michel François Carlos José Juan Luis Miguel Antonio Giovanni Marco Ivan Dmitri Иван Дмитрий Сергей Александр Γιώργος Νίκος".split(),
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Emily Emma Anna Maria Laura Julia Katharina Ursula Sabine Sophie Marie Claire Camille Isabelle Carmen Lucía Ana Giulia Francesca Olga Natalia Elena Анна Мария Елена Ольга Μαρία Ελένη".split(),
}
#: Words before a name that stands without title.
CUES = ("Contact", "Contacts", "Kontakt", "Contacto", "Ansprechpartner", "Name", "Author", "Auteur", "Autor", "Attn", "Dear", "Sincerely", "Regards", "Signed", "Written by", "my name is", "My name is")
_TITLE_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_GIVEN_GENDER = {n.casefold(): g for g, ns in GIVEN.items() for n in ns}
_any_of = lambda words: "|".join(sorted(map(re.escape, words), key=len, reverse=True))
#: A capital of the scripts that surrogates are made for, then letters.
_NAME = r"[A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪİĶĹĻŁŃŅŇŌŐŒŔŘŚŞŠŢŤŪŮŰŲŴŶŸŹŻŽЀ-ЯΆΈ-ΏΑ-Ω][^\W\d_]+(?:[-'’][^\W\d_]+)*"
#: type, what must be in a text for a search to be worth it (one of these strings, or none), pattern; group e is the entity.
PATTERNS = (
    ("email", ("@",), re.compile(r"(?P<e>[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)")),
    ("aws_key", ("AKIA",), re.compile(r"(?<![A-Z0-9])(?P<e>AKIA[0-9A-Z]{16})(?![A-Z0-9])")),
    ("secret", ("=", ":"), re.compile(r"(?i:\b(?:token|password|passwd|secret|api_?key)\s*[=:]\s*[\"']?)(?P<e>[A-Za-z0-9+/_-]{8,})")),
    ("ip", (".",), re.compile(r"(?<![\d.])(?P<e>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?!\.?\d)")),
    ("card", (), re.compile(r"(?<![\d.+-])(?P<e>[3-6]\d{3}([ -]?)\d{4}\2\d{4}\2\d{1,7}|3[47]\d{2}([ -]?)\d{6}\3\d{5})(?![\d-])")),
    ("ssn", ("-",), re.compile(r"(?<![\d-])(?P<e>\d{3}-\d{2}-\d{4})(?![\d-])")),
    ("phone", (), re.compile(r"(?<![\w.+])(?P<e>(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5})(?!\d)")),
    ("iban", (), re.compile(r"(?<![A-Z0-9])(?P<e>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")),
    ("person", tuple(_TITLE_GENDER), re.compile(rf"(?<!\w)(?P<t>{_any_of(_TITLE_GENDER)})\.? (?P<e>{_NAME}(?: {_NAME}){{0,2}})(?!\w)")),
    ("person", CUES, re.compile(rf"(?<!\w)(?:{_any_of(CUES)})[:,]?\s(?P<e>{_NAME} {_NAME}(?: {_NAME})?)(?!\w)")),
    ("person", tuple(f"{n} " for ns in GIVEN.values() for n in ns), re.compile(rf"(?<!\w)(?P<e>(?:{_any_of(n for ns in GIVEN.values() for n in ns)}) {_NAME}(?: {_NAME})?)(?!\w)")),
)
_THREE_DIGITS = re.compile(r"\d{3}|\d\.\d")
DIGIT_TYPES = {"ip", "card", "ssn", "phone", "iban"}
ONSETS = {"latin": "b d f g k l m n p r s t v".split(), "cyrillic": "б д ф г к л м н п р с т в".split(), "greek": "β δ φ γ κ λ μ ν π ρ σ τ".split()}
VOWELS = {"latin": "a e i o u".split(), "cyrillic": "а е и о у".split(), "greek": "α ε ι ο υ".split()}
ENDS = {"latin": {"m": "n", "f": "a", "": ""}, "cyrillic": {"m": "н", "f": "а", "": ""}, "greek": {"m": "ς", "f": "α", "": ""}}


def detect(text: str | None) -> list[tuple[str, int, int, str]]:
    """(type, start, end, gender) of the entities in text, apart from one another, in order. Earlier patterns win where two overlap."""
    if not text:
        return []
    found: list[tuple[str, int, int, str]] = []
    digits = _THREE_DIGITS.search(text) is not None
    for kind, needs, pattern in PATTERNS:
        if kind in DIGIT_TYPES and not digits or needs and not any(n in text for n in needs):
            continue
        for m in pattern.finditer(text):
            a, b, gender = m.start("e"), m.end("e"), ""
            if kind == "person":
                given = _GIVEN_GENDER.get(m["e"].split(" ")[0].casefold(), "") if " " in m["e"] else ""
                gender = _TITLE_GENDER.get(m.groupdict().get("t") or "", "") or given
            if kind == "secret" and not any(c.isdigit() for c in m["e"]):
                continue
            if kind == "card" and _luhn(re.sub(r"\D", "", m["e"])):
                continue  # an order number or the like
            if all(b <= x or a >= y for _, x, y, _ in found):
                found.append((kind, a, b, gender))
    return sorted(found, key=lambda x: x[1])


def entities_of(kind: str, mention: str, gender: str = "") -> list[tuple[str, str, str]]:
    """(kind, canonical form, gender) of what a mention names: of a person each part of the name, so that a surname alone stays the
    same person's; of an address also its domain. Only the first of several names has the gender."""
    if kind == "person":
        parts = mention.split(" ")
        return [(kind, p.casefold(), gender if i == 0 and len(parts) > 1 else "") for i, p in enumerate(parts)]
    if kind == "email":
        return [(kind, mention.lower(), ""), ("domain", mention.lower().partition("@")[2], "")]
    if kind in ("card", "ssn", "phone"):
        digits = re.sub(r"\D", "", mention)
        return [(kind, digits[1:] if kind == "phone" and len(digits) == 11 and digits[0] == "1" else digits, "")]  # with or without country code, one number
    return [(kind, mention.replace(" ", "") if kind == "iban" else mention, "")]


class Draw:
    """A stream of keyed numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, canon: str, attempt: int):
        self.base, self.n, self.left = (key, f"{kind}\0{canon}\0{attempt}".encode()), 0, 0
        self.bits = 0

    def below(self, n: int) -> int:
        if self.left < 32:
            self.bits = int.from_bytes(hmac.digest(self.base[0], self.base[1] + self.n.to_bytes(4, "big"), hashlib.sha256), "big")
            self.n, self.left = self.n + 1, 256
        x = self.bits & 0xFFFFFFFF
        self.bits >>= 32
        self.left -= 32
        return x * n >> 32

    def some(self, letters: str, n: int) -> str:
        return "".join(letters[self.below(len(letters))] for _ in range(n))


DIGITS, HEX = "0123456789", "0123456789abcdef"
SMALL, LARGE, KEY_LETTERS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _like(draw: Draw, s: str) -> str:
    """s with letters and digits replaced in kind and case."""
    return "".join(draw.some(DIGITS, 1) if c in DIGITS else draw.some(SMALL, 1) if c in SMALL else draw.some(LARGE, 1) if c in LARGE else c for c in s)


def _luhn(digits: str) -> int:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10


def _script(s: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in s) else "greek" if any("Ͱ" <= c <= "Ͽ" for c in s) else "latin"


def stays(domain: str) -> bool:
    """Domains that are set aside for examples are nobody's."""
    return domain.split(".")[:-1] == ["example"]


def surrogate(kind: str, canon: str, attempt: int = 0, gender: str = "", host: str = "", *, key: bytes) -> str:
    """The surrogate's canonical form, of the same type, length and check digits as canon; an address's with the surrogate of its
    domain, `host`. From the attempt WIDE on it is longer."""
    draw, more = Draw(key, kind, canon, attempt), 4 * max(0, attempt - WIDE + 1)
    if kind == "email":
        return _like(draw, canon.partition("@")[0]) + draw.some(SMALL, more) + "@" + host
    if kind == "domain":
        parts = canon.split(".")
        if stays(canon):
            return canon
        tail = parts[-2:] if parts[-2] == "example" else [_like(draw, parts[-2]) + draw.some(SMALL, more), parts[-1]]
        front = [_like(draw, p) for p in parts[:-2]]
        return ".".join([draw.some(SMALL, more) + front[0] if i == 0 and parts[-2] == "example" else p for i, p in enumerate(front)] + tail)
    if kind == "ip":
        if more:
            return "2001:db8:" + ":".join(draw.some(HEX, 4) for _ in range(6))
        return ".".join([str(1 + draw.below(223)), str(draw.below(256)), str(draw.below(256)), str(1 + draw.below(254))])
    if kind == "card":
        body = canon[0] + draw.some(DIGITS, len(canon) - 2 + more)
        valid = _luhn(canon) == 0
        good = next(d for d in DIGITS if _luhn(body + d) == 0)
        return body + (good if valid else str((int(good) + 1 + draw.below(9)) % 10))
    if kind == "phone":
        country = canon[:-10]
        rest = canon[len(country) :]
        area = "".join([str(2 + draw.below(8)), str(draw.below(10)), str(draw.below(10))])
        keep = "" if rest[3:6] != "555" else rest[3:8] if rest[6:8] == "01" else "555"  # fictional numbers, 555-0100 to 555-0199, stay fictional
        return country + (area + keep + draw.some(DIGITS, max(0, len(rest) - 3 - len(keep))))[: len(rest)] + draw.some(DIGITS, more)
    if kind == "aws_key":
        return "AKIA" + draw.some(KEY_LETTERS, len(canon) - 4 + more)
    if kind == "secret" and re.fullmatch("[0-9a-f]+", canon):
        return draw.some(HEX, len(canon) + more)
    if kind == "iban":
        body = _like(draw, canon[4:]) + draw.some(DIGITS, more)
        check = 98 - int("".join(str(int(c, 36)) for c in body + canon[:2] + "00")) % 97
        return canon[:2] + f"{check:02d}" + body
    if kind == "person":
        script = _script(canon)
        syllables = 2 + draw.below(3) + more // 2
        return "".join(ONSETS[script][draw.below(len(ONSETS[script]))] + VOWELS[script][draw.below(len(VOWELS[script]))] for _ in range(syllables)) + ENDS[script][gender]
    return _like(draw, canon) + draw.some(DIGITS if kind == "ssn" else SMALL, more)


def _dress(kind: str, mention: str, drawn: str) -> str:
    """The canonical surrogate in the mention's format; what is longer goes behind."""
    if kind in ("card", "ssn", "phone", "iban"):
        ahead = len(re.sub(r"\D", "", mention)) - len(drawn) if kind == "phone" else 0
        it = iter("1" * ahead + drawn)
        put = re.sub(r"[^ ]" if kind == "iban" else r"\d", lambda _: next(it), mention)
        return put + "".join(it)
    if kind == "person":
        return drawn.upper() if mention.isupper() else drawn.capitalize() if mention[:1].isupper() else drawn
    if kind == "email" and mention != mention.lower():
        return drawn.upper() if mention.isupper() else "".join(b.upper() if a.isupper() else b for a, b in zip(mention, drawn, strict=False)) + drawn[len(mention) :]
    return drawn


def replace(text: str, settled: dict[tuple[str, str], tuple[int, str]] | None = None, *, key: bytes) -> tuple[str, int]:
    """text with surrogates for its entities, and how many there were. settled: (attempt, gender) of entities that differ from what their place tells."""
    spans, at, out = detect(text), 0, []
    settled = settled or {}
    for kind, a, b, gender in spans:
        mention = text[a:b]
        named = [(k, c, *settled.get((k, c), (0, g))) for k, c, g in entities_of(kind, mention, gender)]
        if kind == "email":
            (_, c, attempt, _), (_, domain, at_domain, _) = named
            new = _dress(kind, mention, surrogate(kind, c, attempt, host=surrogate("domain", domain, at_domain, key=key), key=key))
        else:
            parts = mention.split(" ") if kind == "person" else [mention]
            new = " ".join(_dress(kind, p, surrogate(k, c, attempt, g, key=key)) for p, (k, c, attempt, g) in zip(parts, named, strict=True))
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]) if spans else text, len(spans)


ENTITIES = ArrayType(StructType([StructField("kind", StringType()), StructField("canon", StringType()), StructField("gender", StringType())]))
REPLACED = StructType([StructField("text", StringType()), StructField("n", LongType())])


@pandas_udf(ENTITIES)
def _entities(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: [{"kind": k, "canon": c, "gender": g} for kind, a, b, gender in detect(t) for k, c, g in entities_of(kind, t[a:b], gender)])


def _drawn(key: bytes):
    @pandas_udf(StringType())
    def draw(kind: pd.Series, canon: pd.Series, attempt: pd.Series, gender: pd.Series, host: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, c, a, g, h or "", key=key) for k, c, a, g, h in zip(kind, canon, attempt, gender, host, strict=True)], dtype=object)

    return draw


def settle(entities: DataFrame, key: bytes) -> DataFrame:
    """entities: distinct (kind, canon) with gender and, of addresses, host. The same with `attempt` and `drawn`, no two of a kind alike and none an entity.

    Each round looks at all entities' current surrogates: of those that share one, the smallest canon keeps it."""
    draw = _drawn(key)("kind", "canon", "attempt", "gender", "host")
    columns = ("kind", "canon", "gender", "host", "attempt", "drawn")
    current = written(entities.withColumn("attempt", F.lit(0)).withColumn("drawn", draw).select(*columns))
    for _ in range(ROUNDS):
        first = current.groupBy("kind", "drawn").agg(F.min("canon").alias("_first"))
        real = current.select(F.col("kind").alias("_kind"), F.col("canon").alias("_canon"))
        judged = current.join(first, ["kind", "drawn"]).join(real, (F.col("kind") == F.col("_kind")) & (F.col("drawn") == F.col("_canon")), "left")
        kept = (F.col("kind") == "domain") & F.col("canon").rlike(r"^example\.[^.]+$")
        judged = written(judged.withColumn("bad", ~kept & ((F.col("canon") != F.col("_first")) | F.col("_canon").isNotNull())).select(*columns, "bad"))
        if judged.where("bad").isEmpty():
            return judged.drop("bad")
        again = judged.where("bad").withColumn("attempt", F.col("attempt") + 1).withColumn("drawn", draw)
        current = written(judged.where("not bad").select(*columns).unionByName(again.select(*columns)))
    raise RuntimeError("surrogates still collide after the widest draws")


def settled_entities(found: DataFrame, key: bytes) -> DataFrame:
    """found: kind, canon, gender as each mention's place tells. kind, canon, gender, attempt, drawn of each entity in the whole corpus."""
    known = F.when(F.col("gender") != "", F.col("gender"))
    merged = found.groupBy("kind", "canon").agg(F.when(F.min(known) == F.max(known), F.min(known)).otherwise("").alias("gender"))
    merged = written(merged)
    plain = settle(merged.where("kind <> 'email'").withColumn("host", F.lit(None).cast("string")), key)
    hosts = plain.where("kind = 'domain'").select(F.col("canon").alias("_domain"), F.col("drawn").alias("host"))
    mails = merged.where("kind = 'email'").withColumn("_domain", F.substring_index("canon", "@", -1)).join(hosts, "_domain").drop("_domain")
    return plain.unionByName(settle(mails, key)).drop("host")


SETTLED = ArrayType(StructType([StructField("kind", StringType()), StructField("canon", StringType()), StructField("attempt", IntegerType()), StructField("gender", StringType())]))


def replace_pii(docs: DataFrame, key: bytes, count: str | None = None) -> DataFrame:
    """docs with surrogates in `text`; their number in column `count`, if it is named. Who has the key can tell surrogates from a
    list of guesses, so it is the caller's, and secret."""

    @pandas_udf(REPLACED)
    def put(texts: pd.Series, settled: pd.Series) -> pd.DataFrame:
        rows = [(None, 0) if t is None else replace(t, {(x["kind"], x["canon"]): (x["attempt"], x["gender"]) for x in r} if r is not None else None, key=key) for t, r in zip(texts, settled, strict=True)]
        return pd.DataFrame(rows, columns=["text", "n"])

    own = F.xxhash64("doc_id", "text")  # only finds what may differ: another document's entities in the list do no harm
    found = own_names(docs, "doc_id", "text").select(own.alias("_key"), F.explode(_entities("text")).alias("e")).select("_key", "e.*").distinct()
    found = written(found)
    entities = settled_entities(found.select("kind", "canon", "gender").distinct(), key).select("kind", "canon", "attempt", F.col("gender").alias("_gender"))
    differ = found.join(entities, ["kind", "canon"]).where((F.col("attempt") > 0) | (F.col("gender") != F.col("_gender")))
    of_doc = written(differ.groupBy("_key").agg(F.collect_set(F.struct("kind", "canon", "attempt", F.col("_gender").alias("gender"))).cast(SETTLED).alias("_settled")))  # a document's own entities
    rows = carried(docs, "doc_id", "text").withColumn("_key", own)
    joined = rows.join(of_doc, "_key", "left").withColumn("_put", put("text", "_settled"))
    columns = [F.col("_put.text").alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns if c != count]
    return joined.select(*columns, *([F.col("_put.n").alias(count)] if count else []))


def key_of(spark: SparkSession) -> bytes:
    """The session's key, or that for synthetic tables."""
    found = spark.conf.get(KEY_SETTING, "")
    return found.encode() if found else TABLES_KEY


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(own_names(table(spark, sf_dir, "documents"), "doc_id", "text"), key_of(spark), count="n_entities")

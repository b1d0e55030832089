"""Personal data: information-theoretic sanitisation.

Protected entities are the e-mail addresses, IP addresses, card and telephone
numbers that patterns and check sums find, and secrets (long runs in which digits
and letters alternate as they do not in words).  Each value is an entity, and so
is each kind: that a document holds some secret at all is to be protected too.

How strongly a term reveals an entity is estimated from the corpus.  p(e) is the
share of documents that hold entity e, p(e | t) the share of the documents with
term t that hold e, both at any distance.  The term discloses the share
PMI(e, t) / IC(e) = 1 - log p(e | t) / log p(e) of the entity's information.
Terms that disclose GENERALISE or more are protected like the entity wherever they
occur: they are replaced by the kind of what they reveal, from REMOVE on they go.

A few joint documents may be chance.  A pair counts only if so many joint
documents would arise by chance, in any of the pairs of all entities and all terms
(at most half as many as characters), with a probability under ALPHA (Chernoff's
bound of the binomial tail).  For this test documents that repeat each other are
one: the term's contexts (the words around its first place) are counted, not the
documents.  An entity whose
documents are so few that no term could pass is left out before any pairs are
made; this loses nothing.  Entities that more than one document in 2 ** BITS holds
have too little information to be disclosed.

Scale: one pass over the documents gathers the entities and terms of those that
hold entities; aggregations and joins by key find the pairs that could pass; a
second pass counts the documents that hold the terms of these.  Terms are
broadcast if they are no more than TERMS, else joined.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, hand_back, ship, small_batches, written

#: The kinds that patterns define, and those that can be entities.
KINDS = ("email", "ip", "card", "phone")
ENTITIES = (*KINDS, "secret")
SECRET = len(KINDS)
#: Words on either side of a term that make its context.
NEAR = 3
GENERALISE, REMOVE = 0.95, 0.99
ALPHA, BITS = 0.01, 3
#: Terms that are broadcast at most.
TERMS = 200_000
#: Characters of a term that are kept as they are; longer ones are named by a hash.
LONGEST = 64
#: Distinct terms that a task counts before it hands them on.
COUNTED = 200_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# matches start where a run of digits starts, so the look-behind changes no match and keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"\w+")
_RUN = re.compile(r"[A-Za-z0-9_-]{20,}")
_SWITCH = re.compile(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    pos = 0
    while (at := text.find("@", pos)) >= 0:
        start = at
        while start > pos and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        pos = m.end() if m else at + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def find(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) in code points, by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The places of spans, in order, without overlaps."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _outside(found: Iterator[re.Match], taken: list[tuple[int, int]]) -> Iterator[re.Match]:
    """The matches (in order) that overlap none of the taken places (in order)."""
    i = 0
    for m in found:
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if i == len(taken) or m.end() <= taken[i][0]:
            yield m


def secrets(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of 20 or more letters, digits, - and _ of whose neighbours every eighth or more pass from digit to letter or back; none that touch base spans."""
    if not _DIGIT.search(text):
        return []
    runs = (m for m in _RUN.finditer(text) if 8 * sum(1 for _ in _SWITCH.finditer(m.group())) >= m.end() - m.start())
    return [(SECRET, m.start(), m.end()) for m in _outside(runs, _merged(base))]


def _number(text: str) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(text, 7)).astype(np.int64))


def _value(kind: int, text: str) -> int:
    """A signed 64-bit name of the entity, the same however it is written."""
    return _number(f"{kind}:{''.join(c for c in text if c.isdigit()) if kind in (2, 3) else text.lower()}")


def name_of(word: str) -> str:
    """The term that a word of a text is, wherever it is counted or marked."""
    name = word.lower()
    return name if len(name) <= LONGEST else f"\x01{xxhash.xxh64_hexdigest(name, 7)}"


def evidence(text: str) -> tuple[list[tuple[int, int]], dict[str, int]]:
    """The (entity, kind) of one document, kinds being entities with their own number, and the terms beside them with their contexts; without entities nothing."""
    spans = find(text)
    spans += secrets(text, spans)
    if not spans:
        return [], {}
    named = dict.fromkeys((_value(k, text[a:b]), k) for k, a, b in spans) | dict.fromkeys((k, k) for k, _, _ in spans)
    words = [name_of(m.group()) for m in _outside(_TERM.finditer(text), _merged(spans))]
    terms: dict[str, int] = {}
    for i, w in enumerate(words):
        if w not in terms:
            terms[w] = _number(" ".join(words[max(0, i - NEAR) : i + NEAR + 1]))
    return list(named), terms


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


_GATHERED = "key long, entities array<struct<entity: long, kind: int>>, terms array<string>, numbers array<long>"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts that hold entities: key, entities, terms and contexts; and a row without a key: the task's number of characters."""
    kinds = pa.list_(pa.struct([("entity", pa.int64()), ("kind", pa.int32())]))
    chars = 0

    def batch_of(rows) -> pa.RecordBatch:
        key, entities, terms, numbers = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(entities, kinds), pa.array(terms, pa.list_(pa.string())), pa.array(numbers, pa.list_(pa.int64()))], ["key", "entities", "terms", "numbers"])

    for batch in small_batches(batches):
        rows = []
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = value.as_py()
            chars += len(text)
            entities, terms = evidence(text)
            if entities:
                rows.append((key, [{"entity": e, "kind": k} for e, k in entities], list(terms), list(terms.values())))
        if rows:
            yield batch_of(rows)
    yield batch_of([(None, [], [], [chars])])
    hand_back()


def _terms(text: str) -> Iterator[str]:
    """The distinct terms of a text, those inside entities too."""
    return map(name_of, set(_TERM.findall(text)))


def _counted(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, with_term): how many texts hold each of the terms."""
    sent = texts.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in terms.collect())) if terms.count() <= TERMS else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])
            counts.clear()
            return out

        for batch in small_batches(batches):
            for text in batch.column(0):
                found = set(_terms(text.as_py()))
                for t in found if sent is None else sent.value.intersection(found):
                    counts[t] = counts.get(t, 0) + 1
            if len(counts) > COUNTED:
                yield emit()
        yield emit()
        hand_back()

    found = texts.mapInArrow(count, "term string, n long")
    return (found if sent is not None else found.join(terms, "term")).groupBy("term").agg(F.sum("n").alias("with_term"))


def _small(df: DataFrame) -> DataFrame:
    """A written table, broadcast in joins if it has few rows."""
    return F.broadcast(df) if df.count() <= 100_000 else df


def disclosing(docs: DataFrame, text_col: str = "text", generalise: float = GENERALISE, alpha: float = ALPHA, bits: float = BITS) -> DataFrame:
    """(term, kind, share): the terms that reveal a protected entity by generalise or more, and the number of that entity's kind.

    Null texts are empty.  Repeated rows are documents of their own in p(e) and
    p(e | t), and one in the test of chance.  Terms are runs of letters, digits and
    underscores, in lower case; next to an entity only those outside entities count.  Only the text column is read; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    none = "term string, kind int, share double"
    texts = _texts(docs, text_col)
    gathered = written(texts.select(F.monotonically_increasing_id().alias("key"), "text").mapInArrow(_gather, _GATHERED))
    held = gathered.filter("key IS NOT NULL")
    n, chars = docs.count(), gathered.filter("key IS NULL").agg(F.sum(F.col("numbers")[0])).first()[0] or 0
    named = held.select("key", F.explode("entities").alias("e")).select("key", "e.entity", "e.kind")
    entities = checkpoint(named.groupBy("entity", "kind").agg(F.count("*").alias("with_entity")).withColumn("ic", -F.log(F.col("with_entity") / F.lit(max(n, 1)))))
    tests = entities.count() * (chars + 1) // 2
    if not tests:
        return spark.createDataFrame([], none)
    bound = math.log(tests / alpha)
    # k joint documents are worth k x IC nats at most
    strong = checkpoint(entities.filter((F.col("ic") >= bits * math.log(2)) & (F.col("with_entity") * F.col("ic") >= bound)))
    own = named.join(_small(strong.select("entity")), "entity").groupBy("key").agg(F.collect_list("entity").alias("own"))
    each = held.select("key", "terms", "numbers").join(own, "key").select(F.explode("own").alias("entity"), "terms", "numbers")
    rows = each.select("entity", F.explode(F.arrays_zip("terms", "numbers")).alias("p")).select("entity", F.col("p.terms").alias("term"), F.col("p.numbers").alias("context"))
    joint = rows.groupBy("entity", "term", "context").agg(F.count("*").alias("docs")).groupBy("entity", "term").agg(F.sum("docs").alias("both"), F.count("*").alias("contexts"))
    joint = joint.join(_small(strong), "entity").filter(F.col("contexts") * F.col("ic") >= bound)
    # p(e | t) is no more than the share of e among the documents that hold t and any entity
    among = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("among"))
    joint = written(joint.join(among, "term").filter(1 + F.log(F.col("both") / F.col("among")) / F.col("ic") >= generalise).drop("among"))
    counts = checkpoint(_counted(texts, joint.select("term").distinct()))
    shares = joint.join(counts, "term").withColumn("p", F.col("both") / F.col("with_term"))
    shares = shares.withColumn("share", 1 + F.log("p") / F.col("ic")).filter(F.col("share") >= generalise)
    base = F.col("with_entity") / F.lit(max(n, 1))
    apart = F.when(F.col("p") < 1, (1 - F.col("p")) * F.log((1 - F.col("p")) / (1 - base))).otherwise(0.0)
    nats = F.col("contexts") / F.col("p") * (F.col("p") * F.log(F.col("p") / base) + apart)
    best = shares.filter(nats >= bound).groupBy("term").agg(F.max(F.struct("share", (-F.col("kind")).alias("k"))).alias("m"))
    return checkpoint(best.select("term", (-F.col("m.k")).cast("int").alias("kind"), F.col("m.share").alias("share")))


def _replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, tag in sorted(spans):
        if a >= at:
            out += [text[at:a], tag]
            at = b
        else:  # overlaps what is gone already
            at = max(at, b)
    return "".join([*out, text[at:]])


def _marked(text: str, table: dict[str, tuple[int, float]], with_text: bool) -> tuple:
    """The values of protect's columns after the id, for one text; table: the disclosing terms, or at least those that the text has."""
    base = find(text)
    own = base + secrets(text, base)
    terms = []
    if table and not table.keys().isdisjoint(_terms(text)):
        for m in _outside(_TERM.finditer(text), _merged(own)):
            hit = table.get(name_of(m.group()))
            if hit is not None:
                terms.append((m.start(), m.end(), "" if hit[1] >= REMOVE else f"[{ENTITIES[hit[0]].upper()} TERM]"))
    joined = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    counts = [sum(k == i for k, _, _ in own) for i in range(len(ENTITIES))]
    out = (*counts, len(terms), joined((KINDS[k], a, b) for k, a, b in base), joined((ENTITIES[k], a, b) for k, a, b in own[len(base) :]), joined(("term", a, b) for a, b, _ in terms))
    return (*out, _replaced(text, [(a, b, f"[{ENTITIES[k].upper()}]") for k, a, b in own] + terms)) if with_text else out


def protect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, n_secret, n_term, base (spans by pattern), secrets, terms (spans of disclosing terms) and the sanitised text.

    Spans are kind:start:end in code points, end exclusive, joined by commas.  No
    secret or term overlaps a span that is listed before it.  A null text is empty
    and stays empty.  Every row of docs gives one row; repeated rows give equal
    rows.  Other columns are not read.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    found = disclosing(docs, text_col)
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    few = found.count() <= TERMS
    if few:
        sent = spark.sparkContext.broadcast({r["term"]: (r["kind"], r["share"]) for r in found.collect()})
    else:
        sent = None

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches):
                pairs = [(h, t) for h, text in zip(batch.column(0).to_pylist(), batch.column(1)) for t in dict.fromkeys(map(name_of, _TERM.findall(text.as_py())))]
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in pairs], pa.int64()), pa.array([t for _, t in pairs], pa.string())], ["h", "term"])

        # terms of a text that only shares another's hash do no harm: a term is marked where it stands
        own = rows.select(F.xxhash64("text").alias("h"), "text").mapInArrow(words, "h long, term string").join(found, "term")
        own = checkpoint(own.distinct().groupBy("h").agg(F.collect_list(F.struct("term", "kind", "share")).alias("own")))
        rows = rows.withColumn("th", F.xxhash64("text")).join(own, F.col("th") == F.col("h"), "left").select("id", "text", "own")
    names = ["id", *(f"n_{k}" for k in ENTITIES), "n_term", "base", "secrets", "terms", *(["text"] if with_text else [])]
    kinds = [id_type, *[T.LongType()] * (len(ENTITIES) + 1), *[T.StringType()] * (4 if with_text else 3)]
    types = [*[pa.int64()] * (len(ENTITIES) + 1), *[pa.string()] * (4 if with_text else 3)]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            tables = [{x["term"]: (x["kind"], x["share"]) for x in own or ()} for own in batch.column(2).to_pylist()] if sent is None else [sent.value] * batch.num_rows
            out = [_marked(text.as_py(), table, with_text) for text, table in zip(batch.column(1), tables)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*out), types)]], names)
        hand_back()

    return rows.mapInArrow(mark, T.StructType([T.StructField(a, b) for a, b in zip(names, kinds)]))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (base, secrets, terms), n_secret, n_term and n_spans for every row of documents; edge cases as in ``protect``."""
    found = protect(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
    spans = F.concat_ws(",", *[F.when(F.col(c) != "", F.col(c)) for c in ("base", "secrets", "terms")])
    counts = [f"n_{k}" for k in (*ENTITIES, "term")]
    total = sum((F.col(c) for c in counts[1:]), F.col(counts[0]))
    return found.select(F.col("id").alias("doc_id"), *counts[:4], F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"), *counts[4:], total.alias("n_spans"))

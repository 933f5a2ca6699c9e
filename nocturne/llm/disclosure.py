"""Personal data: spans by pattern, and terms that give their owners away.

The patterned spans of a text name protected entities.  All words near an entity
are terms; over the whole corpus it is counted how many documents hold a term
near an entity, in how many different surroundings (copies say it once), and how
many hold the term at all.  ``P(entity | term) = near / holding`` is smoothed: the
surroundings weigh against the chance ``P(entity)``, which has ``WEIGHT`` of them.
A term discloses an entity if the smoothed posterior

* is at least ``POSTERIOR``, and
* says at least ``BITS`` more than chance, ``log2 P(e | t) / P(e)``.

One surroundings alone cannot reach both: a term of a single text, or of its
copies, is left.  Terms that disclose are spans wherever they stand.  In
sanitised text entities become placeholders, terms are generalised, and those
above ``REMOVE`` removed.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nocturne.llm.common import map_texts
from nocturne.session import stage

WINDOW = 6  # words on either side of an entity
POSTERIOR, REMOVE, BITS = 0.6, 0.9, 4.0
WEIGHT = 1.0  # of chance in the posterior, as that many different surroundings
BLOCK = 200_000  # terms that one pass looks for
KINDS = ["email", "ip", "card", "phone", "term"]
# The patterns of the base kinds.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    # a match can begin at the first of adjacent digits only; saying so spares long numbers
    "ip": re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
LOWERED = {c: c + 32 for c in range(65, 91)}
PLACEHOLDER = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}

Span = tuple[int, int, str]  # start, kind, end as (start, end, kind)


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind: str, found: str) -> bool:
    if kind == "ip":
        parts = [p.lstrip("0") for p in found.split(".")]
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)
    if kind == "card":
        n = digits(found)
        return 14 <= len(n) <= 19 and luhn(n)
    if kind == "phone":
        return 10 <= len(digits(found)) <= 15
    return True


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, found from the at signs outwards: the
    leftmost match that holds an at sign starts at the first of the characters
    before it that may stand there, and after the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    spans = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    for kind in ("ip", "card", "phone"):
        spans += [(m.start(), m.end(), kind) for m in PATTERNS[kind].finditer(text) if valid(kind, m[0])]
    return sorted(spans, key=order)


def order(span: Span) -> tuple[int, int]:
    return span[0], KINDS.index(span[2])


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def entity(kind: str, found: str) -> int:
    """Name of an entity: spelling without case, punctuation of numbers aside."""
    plain = found.lower() if kind in ("email", "ip") else digits(found)
    return xxhash.xxh3_64_intdigest(f"{kind}:{plain}") - 2**63


def term_of(word: str) -> str | None:
    """A word as a term: A-Z lowered, no ASCII punctuation around it; null if nothing is left."""
    return word.strip(EDGES).translate(LOWERED) or None


def near_terms(text: str, spans: list[Span]) -> Iterator[tuple[int, str, int]]:
    """(entity, term, surroundings): each entity and term once per text, with the
    name of all the surroundings in which the text holds them."""
    words = [m[0] for m in WORD.finditer(text)]
    starts = [m.start() for m in WORD.finditer(text)]
    within = [(bisect_right(starts, a) - 1, bisect_left(starts, b) - 1) for a, b, _ in spans]
    for first, last in within:  # words of entities are no terms
        words[first : last + 1] = [""] * (last + 1 - first)
    seen = defaultdict(set)
    for (a, b, kind), (first, last) in zip(spans, within):
        around = [term_of(w) for w in words[max(0, first - WINDOW) : first] + words[last + 1 : last + 1 + WINDOW]]
        where = xxhash.xxh3_64_intdigest(" ".join(t or "" for t in around)) - 2**63
        name = entity(kind, text[a:b])
        for t in filter(None, around):
            seen[name, t].add(where)
    for (name, t), places in seen.items():
        yield name, t, xxhash.xxh3_64_intdigest(" ".join(map(str, sorted(places)))) - 2**63


def occurrences(docs: DataFrame) -> DataFrame:
    """entity, term, surroundings, one row per document; term null: the entity itself."""

    def rows(source):
        for _, raw in source:
            text = raw.decode()
            spans = base_spans(text)
            if spans:
                yield from near_terms(text, spans)
                for name in {entity(k, text[a:b]) for a, b, k in spans}:
                    yield name, None, 0

    return map_texts(docs, "entity long, term string, surroundings long", rows)


def smoothed(posterior: Column) -> Column:
    """The posterior, weighed by the different surroundings against chance."""
    return (F.col("contexts") * posterior + WEIGHT * F.col("chance")) / (F.col("contexts") + WEIGHT)


def discloses(posterior: Column) -> Column:
    s = smoothed(posterior)
    return (s >= POSTERIOR) & (F.log2(s / F.col("chance")) >= BITS)


def candidates(docs: DataFrame) -> DataFrame:
    """term, entity, near (documents), contexts, chance (share of the documents
    that hold the entity), for pairs that disclose if nothing else holds the term."""
    seen = stage(occurrences(docs).groupBy("entity", "term", "surroundings").count(), "occurrences")
    pairs = seen.where(F.col("term").isNotNull()).groupBy("entity", "term").agg(
        F.sum("count").alias("near"), F.count("*").alias("contexts"))
    entities = seen.where(F.col("term").isNull()).groupBy("entity").agg(
        (F.sum("count") / F.lit(docs.count())).alias("chance"))
    return pairs.join(entities, "entity").where(discloses(F.lit(1.0))).select(
        "term", "entity", "near", "contexts", "chance")


def blocks_of(terms: DataFrame, block: int) -> list[DataFrame]:
    """Parts of about ``block`` terms each, by a hash; one pass looks for one part."""
    n = -(-terms.count() // block)
    return [terms.where(F.pmod(F.xxhash64("term"), F.lit(n)) == i) for i in range(n)]


def holds(raw: bytes, wanted: dict[bytes, float]) -> set[bytes]:
    """Those of the wanted terms that a text holds."""
    edges = EDGES.encode()
    return wanted.keys() & {w.strip(edges) for w in raw.lower().split()} if wanted else set()


def holding(docs: DataFrame, terms: DataFrame, block: int = BLOCK) -> DataFrame | None:
    """term, holding: documents that hold it, for the given distinct terms."""
    out = None
    for part in blocks_of(terms, block):
        wanted = docs.sparkSession.sparkContext.broadcast(
            {r.term.encode(): 1.0 for r in part.toLocalIterator()})

        def rows(source, wanted=wanted):
            n = Counter()  # of at most the block's terms
            for _, raw in source:
                n.update(holds(raw, wanted.value))
            yield from ((w.decode(), k) for w, k in n.items())

        found = map_texts(docs, "term string, n long", rows).groupBy("term").agg(F.sum("n").alias("holding"))
        out = found if out is None else out.union(found)
    return out


def disclosing(docs: DataFrame) -> DataFrame:
    """term, posterior of the terms above the thresholds, each once; staged."""
    pairs = stage(candidates(docs), "candidates")
    terms = stage(pairs.select("term").distinct(), "terms")
    held = holding(docs, terms)
    if held is None:
        return pairs.select("term", F.lit(0.0).alias("posterior")).limit(0)
    posterior = F.col("near") / F.col("holding")
    told = pairs.join(held, "term").where(discloses(posterior)).withColumn("posterior", posterior)
    return stage(told.groupBy("term").agg(F.max("posterior").alias("posterior")), "disclosing")


def term_spans(text: str, spans: list[Span], wanted: dict[bytes, float]) -> list[Span]:
    """Places of the wanted terms outside the base spans."""
    out = []
    for m in WORD.finditer(text):
        t = term_of(m[0])
        if t and t.encode() in wanted:
            a = m.start() + len(m[0]) - len(m[0].lstrip(EDGES))
            b = m.end() - (len(m[0]) - len(m[0].rstrip(EDGES)))
            if not any(x < b and y > a for x, y, _ in spans):
                out.append((a, b, "term"))
    return out


def broadcast_blocks(docs: DataFrame, terms: DataFrame, block: int) -> list:
    context = docs.sparkSession.sparkContext
    return [context.broadcast({r.term.encode(): r.posterior for r in part.toLocalIterator()})
            for part in blocks_of(terms, block)]


def find(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every text.

    Null and empty texts have no spans.  Repeated rows are searched one by one;
    null ids stay; further columns are dropped."""
    found = broadcast_blocks(docs, disclosing(docs), block)
    schema = ("row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
              "base_sha256 string, base string, terms string")

    def passes(terms):
        def rows(source):
            wanted = terms.value if terms else {}
            for doc_id, raw, row in source:
                text = raw.decode()
                base = base_spans(text)
                more = term_spans(text, base, wanted) if holds(raw, wanted) else []
                counts = [sum(k == kind for _, _, k in base) for kind in KINDS[:4]]
                digest = hashlib.sha256(written(base).encode()).hexdigest()
                yield (row, doc_id, *counts, digest, written(base), written(more))

        return map_texts(docs.withColumn("row", F.monotonically_increasing_id()), schema, rows, "row")

    out = passes(found[0] if found else None)
    for terms in found[1:]:  # more terms than one pass takes: joined by row
        other = passes(terms).select("row", F.col("terms").alias("more"))
        out = out.join(other, "row").withColumn("terms", F.concat("terms", F.lit(","), "more")).drop("more")
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
                      in_order(F.col("base"), F.col("terms")).alias("spans"))


def in_order(base: Column, terms: Column) -> Column:
    """Both lists as one, by start and then kind."""
    both = F.filter(F.concat(F.split(base, ","), F.split(terms, ",")), lambda s: s != "")
    keyed = F.transform(both, lambda s: F.struct(
        F.split(s, ":")[1].cast("long").alias("at"),
        F.array_position(F.lit(KINDS), F.split(s, ":")[0]).alias("kind"), s.alias("span")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: x["span"]), ",")


def clean(text: str, wanted: dict[bytes, float], entities: bool) -> str:
    """The text with entities replaced, terms generalised or removed."""
    base = base_spans(text)
    spans = sorted((base if entities else []) + (term_spans(text, base, wanted) if wanted else []), key=order)
    out, done = [], 0
    for a, b, kind in spans:
        if a < done:  # within a longer span, whose end may move
            done = max(done, b)
            continue
        out.append(text[done:a])
        gone = kind == "term" and wanted[term_of(text[a:b]).encode()] >= REMOVE
        out.append("" if gone else PLACEHOLDER[kind])
        done = b
    return "".join(out) + text[done:]


def sanitise(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows with sanitised text and its n_chars; null texts stay null."""
    found = broadcast_blocks(docs, disclosing(docs), block)

    def cleaner(terms, entities):
        @F.pandas_udf("string")
        def cleaned(texts: pd.Series) -> pd.Series:
            wanted = terms.value if terms else {}
            return texts.map(lambda t: None if t is None else clean(t, wanted, entities))

        return cleaned

    # entities go last, so that every pass sees them and leaves them alone
    for terms in found:
        docs = docs.withColumn("text", cleaner(terms, False)("text"))
    docs = docs.withColumn("text", cleaner(None, True)("text"))
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))

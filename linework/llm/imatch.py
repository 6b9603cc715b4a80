"""I-Match document fingerprints.

The lexicon holds the terms whose inverse document frequency lies in a band: neither so frequent that
they tell nothing nor so rare that a slip of the pen changes them. A document's distinct terms of
the lexicon are sorted and the list is hashed, once whole and once for each of 63 randomised subsets of
the lexicon: two documents that differ only in terms which a subset lacks have equal hashes there. 15 subsets keep half to
most of the lexicon, as the method is published, and tell slight edits; 48 keep from a sixteenth down, since after an edit of a
third of a text every subset that keeps most has some changed term. A fingerprint is the number of chosen terms and
the list of 64-bit hashes. A subset that keeps a share s has equal hashes with the probability (1 - s)^d after d changed
terms, so the likeness of two fingerprints is the Jaccard similarity of their terms by the likeliest d.

The lexicon is at most (mean distinct terms of a document) / e^-IDF_HIGH terms, at any number of documents,
since each takes that share of the documents. It is broadcast as sorted 8-byte hashes if it has at most LEXICON_MOST; beyond
that the band narrows from its rare end until it has, which is a rule on document frequencies alone, and is reported.

Defined cases: a null or empty text has no terms and the fingerprint of the empty set; a text without terms of
the lexicon is hashed by all its terms. Two fingerprints of no terms have likeness 1, equal ones 1, and those that agree in no subset 0.
Documents follow by falling doc_id (null last, equal ones in an order that depends on nothing but their texts); the next of the last is the first, of a single one
itself. Repeated rows have results of their own; an empty table gives none; other columns are left alone. A very long text is held
whole by one task, with its neighbour's; equal doc_ids are neighbours and lie in one range, which is a stream.
"""

from __future__ import annotations

import hashlib
import logging

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, cut, hash_words, mix64, table, text_bytes, words

log = logging.getLogger(__name__)

#: The band, in natural logarithms of documents over document frequency.
IDF_LOW, IDF_HIGH = 1.6, 7.6
#: Terms of the lexicon at most: 64 MB as they are broadcast.
LEXICON_MOST = 8_000_000
#: Bytes of texts that a task works on at once, a single longer text aside.
HELD = 2_000_000
#: Shares of the lexicon that subsets keep, and how many are drawn for each; the first subset is the whole.
KEEP = ((0.9, 5), (0.7, 5), (0.5, 5), (1 / 16, 6), (1 / 64, 14), (1 / 256, 14), (1 / 1024, 14))
SUBSETS = np.array([1.0, *(share for share, n in KEEP for _ in range(n))])
SEEDS = mix64(np.arange(1, len(SUBSETS) + 1, dtype=U) * U(0x9E3779B97F4A7C15))
#: A term is in a subset if the upper half of its hash for the subset's seed is below this.
LIMITS = np.rint(SUBSETS * 2**32).astype(U)


def terms(raw: bytes) -> np.ndarray:
    """Sorted hashes of the distinct words."""
    found = words(raw)
    return np.unique(hash_words(list({*found}))) if found else np.empty(0, U)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(t, df) over all documents, combined in each task before the shuffle."""

    def run(batches):
        held, size = [], 0

        def out():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], names=["t", "n"])

        for batch in batches:
            for raw in text_bytes(batch):
                held.append(terms(raw))
                size += len(held[-1])
                if size > 4_000_000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("df"))


def lexicon(docs: DataFrame, idf_low: float = IDF_LOW, idf_high: float = IDF_HIGH, most: int = LEXICON_MOST) -> np.ndarray:
    """Sorted hashes of the terms in the band. What the driver gets is bounded by ``most``: of more terms those of the least
    frequencies go, whole frequencies at a time."""
    n = docs.select("doc_id").count()
    found = cut(document_frequencies(docs).where((F.col("df") > 1) & (F.col("df") >= n * float(np.exp(-idf_high))) & (F.col("df") <= n * float(np.exp(-idf_low)))), "lexicon")
    least = 0
    if found.count() > most:
        # a row for each frequency in the band, in classes of a thousandth of their logarithm
        classes = found.groupBy(F.floor(F.log("df") * 1000).alias("c")).agg(F.count("*").alias("n"), F.min("df").alias("df")).orderBy(F.desc("c")).collect()
        total, least = 0, n + 1
        for r in classes:
            total += r.n
            if total > most:
                break
            least = r.df
        log.warning("the band ends at %d documents, as there are more than %d terms", least, most)
    return np.sort(found.where(F.col("df") >= least).select("t").toPandas()["t"].to_numpy().astype(np.int64).view(U))


def list_hash(t: np.ndarray) -> int:
    """Of a sorted list of term hashes 64 bits, never 0; 0 of the empty one."""
    return int.from_bytes(hashlib.blake2b(t.tobytes(), digest_size=8).digest(), "little") or 1 if len(t) else 0


def membership(t: np.ndarray) -> np.ndarray:
    """For each term a word whose k-th bit says whether it is in the k-th subset."""
    out = np.zeros(len(t), U)
    for k, (seed, limit) in enumerate(zip(SEEDS, LIMITS, strict=True)):
        out |= ((mix64(t ^ seed) >> U(32)) < limit).astype(U) << U(k)
    return out


class Fingerprints:
    """Fingerprints by a lexicon; which subsets a term is in is worked out once."""

    def __init__(self, lex: np.ndarray):
        self.lex = lex
        self.member = membership(lex)

    def selected(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The sorted distinct terms that are in the lexicon, without any all, and their membership()."""
        t = terms(raw)
        if len(t) and len(self.lex):
            at = np.minimum(np.searchsorted(self.lex, t), len(self.lex) - 1)
            at = at[self.lex[at] == t]
            if len(at):
                return self.lex[at], self.member[at]
        return t, membership(t)

    def of(self, raw: bytes) -> np.ndarray:
        """The number of chosen terms, then one 64-bit hash for each subset, 0 for an empty selection."""
        t, member = self.selected(raw)
        out = np.zeros(1 + len(SUBSETS), U)
        out[0] = len(t)
        if len(t):
            kept = np.unpackbits(member.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T.astype(bool)
            for k in np.flatnonzero(kept.any(1)):
                out[1 + k] = list_hash(t[kept[k]])
        return out


def written(f: np.ndarray) -> bytes:
    return f.astype(">u8").tobytes()


#: For each share that subsets keep: where they begin among them, how many, and -log of the share they lack.
_DRAWN = np.array([n for _, n in KEEP])
_FIRST = np.cumsum(_DRAWN) - _DRAWN
_SLOPES = -np.log1p(-np.array([share for share, _ in KEEP]))


def likenesses(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows of two arrays of fingerprints the Jaccard similarity of their terms by the likeliest number of changed ones, at
    which the score function, which falls, is 0."""
    alike = a[:, 2:] == b[:, 2:]
    total = a[:, 0].astype(float) + b[:, 0].astype(float)
    out = np.where((a == b).all(1), 1.0, 0.0)
    rows = np.flatnonzero((out == 0) & alike.any(1))
    if len(rows):
        # subsets of one share are drawn alike, so their number that agrees is all that matters
        agreeing = np.stack([alike[rows][:, at : at + n].sum(1) for at, n in zip(_FIRST, _DRAWN, strict=True)], 1)
        low, high = np.zeros(len(rows)), total[rows]
        for _ in range(40):
            d = (low + high) / 2
            p = np.exp(-_SLOPES * d[:, None])
            more = (_SLOPES * ((_DRAWN - agreeing) * p / np.maximum(1 - p, 1e-300) - agreeing)).sum(1) > 0
            low, high = np.where(more, d, low), np.where(more, high, d)
        out[rows] = np.maximum(0.0, (total[rows] - low) / (total[rows] + low))
    return out


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the start of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


#: As they are stored; digests and fingerprints become hex at the end.
COLUMNS = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
OPEN = COLUMNS + ", part int, place string, text binary"


def _rows(made: Fingerprints, rows: list[tuple]) -> list[tuple]:
    """Result rows of (doc_id, text, its fingerprint, the following text, its fingerprint)."""
    texts = [edited(text, following).encode() for _, text, _, following, _ in rows]
    own, other, its = (np.array(x, U).reshape(-1, 1 + len(SUBSETS)) for x in ([r[2] for r in rows], [made.of(e) for e in texts], [r[4] for r in rows]))
    near = likenesses(own, other).tolist(), likenesses(own, its).tolist()
    return [(r[0], len(r[1]), hashlib.sha256(e).digest(), written(a), written(b), x, y) for r, e, a, b, x, y in zip(rows, texts, own, other, *near, strict=True)]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def fingerprint(docs: DataFrame) -> DataFrame:
    """One row per document of (doc_id, text). Documents are dealt by ranges of falling doc_id, each
    range a stream; the few that stand at the ends of ranges are joined to their neighbours afterwards."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shared = spark.sparkContext.broadcast(lexicon(docs))
    order = [F.col("doc_id").desc_nulls_last()]

    def shut(batches):
        packer = zstandard.ZstdCompressor(level=3, write_checksum=False)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([packer.compress(raw) for raw in text_bytes(batch)], pa.binary())], names=["doc_id", "text"])

    def run(batches):
        from pyspark import TaskContext

        made, part, opener = Fingerprints(shared.value), TaskContext.get().partitionId(), zstandard.ZstdDecompressor()
        before, out, pairs, size = None, [], [], 0
        for batch in batches:
            for doc_id, shut_text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                doc_id, shut_text = doc_id.as_py(), shut_text.as_py()
                raw = opener.decompress(shut_text)
                own, text = made.of(raw), raw.decode()
                if before is None:
                    out.append((doc_id, *[None] * 6, part, "first", shut_text))
                else:
                    pairs.append((*before[:3], text, own))
                before, size = (doc_id, text, own, shut_text), size + len(raw)
                if size > HELD or len(pairs) >= 256:
                    yield _batch(out + [(*r, part, None, None) for r in _rows(made, pairs)], OPEN)
                    out, pairs, size = [], [], 0
        if out or pairs:
            yield _batch(out + [(*r, part, None, None) for r in _rows(made, pairs)], OPEN)
        if before is not None:
            yield _batch([(before[0], *[None] * 6, part, "last", before[3])], OPEN)

    # texts travel compressed; equal ids come in the order of their compressed texts
    dealt = docs.mapInArrow(shut, "doc_id long, text binary").repartitionByRange(*order).sortWithinPartitions(*order, "text")
    rows = cut(dealt.mapInArrow(run, OPEN), "streams")
    ends = rows.where("place is not null").select("doc_id", "part", "place", "text")
    parts = sorted(r.part for r in ends.where("place = 'first'").select("part").collect())  # one for each range
    follows = spark.createDataFrame([(p, parts[(i + 1) % len(parts)]) for i, p in enumerate(parts)], "part int, next_part int")
    pairs = ends.where("place = 'last'").join(follows, "part").join(ends.where("place = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("following")), "next_part")

    def close(batches):
        made, opener = Fingerprints(shared.value), zstandard.ZstdDecompressor()
        for batch in batches:
            for i, *both in zip(*(batch.column(k) for k in ("doc_id", "text", "following")), strict=True):
                t, f = (opener.decompress(x.as_py()) for x in both)
                yield _batch(_rows(made, [(i.as_py(), t.decode(), made.of(t), f.decode(), made.of(f))]), COLUMNS)

    closed = pairs.select("doc_id", "text", "following").mapInArrow(close, COLUMNS)
    whole = rows.where("place is null").select([x.split()[0] for x in COLUMNS.split(", ")]).unionByName(closed)
    return whole.withColumns({k: F.lower(F.hex(k)) for k in ("edited_sha256", "fingerprint", "edited_fingerprint")})


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(table(spark, sf_dir, "documents", "doc_id", "text"))

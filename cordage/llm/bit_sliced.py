"""Ranked search by a bit-sliced impact index: the best documents for each of a set of texts.

What a term adds to a document's score is a whole number, its impact, known from the counts of the collection. Documents are numbered within
segments; for every term of the queries a segment has one bitmap per bit of the impact (a slice), whose bits are the documents. Only the
64-document words that hold a term are kept. A query's scores come from adding the slices of its terms with carries, for all documents of a segment
and many queries at once; a term that a query repeats is added at the place of each bit of its number. The best are found from the most
significant slice down: documents with the bit set go ahead of those without until as many as asked for are left; of equal scores those with the least ids are taken.
Each segment gives its best; they are ranked together.

Segments are made of the documents that a task reads, so that no postings are shuffled: a first pass counts documents, words and the documents of each term,
a second one builds segments and searches them. A segment ends at ``DOCS`` documents or ``POSTINGS`` postings, which bounds what a task holds. Queries are
dealt in blocks of ``BLOCK_WORDS`` words in all (or one longer text); a block and the weights of its terms are sent to the tasks.

Defined cases: null texts and those without terms are found by nothing and find nothing; a null doc_id comes after all others of its score; rows that
repeat a doc_id are documents of their own; rows that repeat an item_id with another text are ranked each by itself, identical ones are one;
empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cordage.llm.common import plain_terms, staged, trimmed
from cordage.llm.prefix_sums import table_sums

TOP, DOCS, POSTINGS, BLOCK_WORDS = 10, 4096, 1 << 19, 1 << 17
#: Queries that are added up together, and terms whose slices are laid out for that at a time.
TOGETHER, TERMS = 64, 2048
_NO_ID = (1 << 63) - 1


class Block:
    """Queries as numbers of terms: what is sent to the tasks."""

    def __init__(self, texts: list[str | None]):
        self.known: dict[bytes, int] = {}
        self.counts: list[dict[int, int]] = []
        for text in texts:
            counts = Counter(plain_terms(text))
            self.counts.append({self.known.setdefault(t, len(self.known)): n for t, n in counts.items()})

    def plans(self) -> Iterator[tuple[list[int], list[tuple[int, np.ndarray]]]]:
        """Groups of queries of about one length, and their steps: (place, the term of each query or -1), one addition each."""
        by_length = sorted((q for q, c in enumerate(self.counts) if c), key=lambda q: len(self.counts[q]))
        for at in range(0, len(by_length), TOGETHER):
            group, steps = by_length[at : at + TOGETHER], []
            for place in range(max(n for q in group for n in self.counts[q].values()).bit_length()):
                lists = [[t for t, n in self.counts[q].items() if n >> place & 1] for q in group]
                for i in range(max(map(len, lists))):
                    steps.append((place, np.array([x[i] if i < len(x) else -1 for x in lists])))
            yield group, steps


def _counted(text: str | None, known: dict[bytes, int]) -> tuple[int, Counter]:
    """How many terms a text has, and how often it has each known one."""
    words = plain_terms(text)
    counts = Counter(map(known.get, words))
    counts.pop(None, None)
    return len(words), counts


def _statistics(known: dict[bytes, int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, words = np.zeros(len(known), np.int64), 0, 0
        for batch in batches:
            for text in batch.column(0):
                n, counts = _counted(text.as_py(), known)
                docs, words = docs + (n > 0), words + n
                held[list(counts)] += 1
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1, -2], used))), pa.array(np.concatenate(([docs, words], held[used])))], ["term", "n"])

    return trimmed(count)


def statistics(docs: DataFrame, known: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with terms, terms of all of them, and the documents of each known term: one row per term comes to the driver."""
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_statistics(known), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found, held = {-1: 0, -2: 0}, np.zeros(len(known), np.int64)
    for r in rows.collect():
        if r["term"] < 0:
            found[r["term"]] = r["n"]
        else:
            held[r["term"]] = r["n"]
    return found[-1], found[-2], held


def weights(docs: int, held: np.ndarray) -> np.ndarray:
    """1,000 times the log of how rare a term is, rounded down."""
    return np.array([math.floor(1000 * math.log((2.0 * docs + 2) / (2.0 * d + 1))) for d in held.tolist()], np.int64)


class Segment:
    """Slices of the impacts of one segment's documents."""

    def __init__(self, ids: list[int | None], terms: np.ndarray, slots: np.ndarray, impacts: np.ndarray):
        self.ids = np.array([_NO_ID if i is None else i for i in ids], np.int64)
        self.words = -(-len(ids) // 64)
        order = np.lexsort((slots, terms))
        terms, slots, impacts = terms[order], slots[order], impacts[order]
        key = terms * self.words + (slots >> 6)
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        bits = np.uint64(1) << (slots & 63).astype(np.uint64)
        self.height = int(impacts.max(initial=0)).bit_length()
        self.slices = np.zeros((self.height, len(starts)), np.uint64)
        for p in range(self.height if len(starts) else 0):
            # The documents of a word differ, so their bits add up to the word.
            self.slices[p] = np.add.reduceat(np.where(impacts >> p & 1, bits, np.uint64(0)), starts)
        self.word = slots[starts] >> 6
        self.terms, self.first = np.unique(terms[starts], return_index=True)
        self.last = np.append(self.first[1:], len(starts))

    def layout(self, wanted: np.ndarray) -> np.ndarray:
        """The slices of the wanted terms (ascending), all words of each; a term that the segment lacks has none set, as has the row after the last."""
        out = np.zeros((self.height, len(wanted) + 1, self.words), np.uint64)
        _, mine, theirs = np.intersect1d(self.terms, wanted, assume_unique=True, return_indices=True)
        for m, t in zip(mine.tolist(), theirs.tolist(), strict=True):
            a, b = self.first[m], self.last[m]
            out[:, t, self.word[a:b]] = self.slices[:, a:b]
        return out

    def scores(self, steps: list[tuple[int, np.ndarray]], n: int) -> np.ndarray:
        """Slices of the scores of ``n`` queries, the least significant first."""
        # The sum of all steps stays below 2 to this power.
        total = np.zeros((self.height + max((p for p, _ in steps), default=0) + len(steps).bit_length() + 1, n, self.words), np.uint64)
        each = max(1, TERMS // n)
        for at in range(0, len(steps), each):
            part = steps[at : at + each]
            wanted = np.unique(np.concatenate([t for _, t in part]))
            wanted = wanted[wanted >= 0]
            laid = self.layout(wanted)
            for place, terms in part:
                row = np.where(terms < 0, len(wanted), np.searchsorted(wanted, terms))
                carry = np.zeros((n, self.words), np.uint64)
                for p in range(self.height):
                    a, b = total[place + p], laid[p][row]
                    half = a ^ b
                    total[place + p], carry = half ^ carry, (a & b) | (half & carry)
                p = place + self.height
                while carry.any():
                    total[p], carry = total[p] ^ carry, total[p] & carry
                    p += 1
        return total

    def best(self, total: np.ndarray, top: int) -> Iterator[tuple[int, int, int]]:
        """(query, document's slot, score) of the ``top`` best with a score above 0 of every query."""
        ahead, open_ = np.zeros(total.shape[1:], np.uint64), np.bitwise_or.reduce(total, axis=0)
        for bits in total[::-1]:
            with_bit = ahead | (open_ & bits)
            many = (np.bitwise_count(with_bit).sum(axis=1, dtype=np.int64) > top)[:, None]
            open_, ahead = open_ & np.where(many, bits, ~bits), np.where(many, ahead, with_bit)
        for q in range(total.shape[1]):
            sure, rest = _slots(ahead[q]), _slots(open_[q])
            missing = top - len(sure)
            if missing < len(rest):
                rest = rest[np.argsort(self.ids[rest], kind="stable")[: max(0, missing)]]
            for slot in np.concatenate((sure, rest)).tolist():
                bits = (total[:, q, slot >> 6] >> np.uint64(slot & 63) & np.uint64(1)).tolist()
                yield q, slot, sum(b << p for p, b in enumerate(bits))


def _slots(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.astype("<u8").view(np.uint8), bitorder="little"))


def _search(block: Block, worth: np.ndarray, docs: int, words: int, top: int, segment_docs: int, postings: int):
    plans = list(block.plans())

    def found(ids, sizes, held) -> pa.RecordBatch:
        lengths = [len(c) for c in held]
        slots = np.repeat(np.arange(len(ids)), lengths)
        terms = np.fromiter((t for c in held for t in c), np.int64, len(slots))
        often = np.fromiter((n for c in held for n in c.values()), np.int64, len(slots))
        size = np.array([25 + 75 * n * docs // words for n in sizes], np.int64)
        segment = Segment(ids, terms, slots, worth[terms] * (1_000_000_000 * often // (1000 * often + 8 * size[slots])))
        rows = [(group[q], ids[slot], score) for group, steps in plans for q, slot, score in segment.best(segment.scores(steps, len(group)), top)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["item", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, held, n = [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                size, counts = _counted(text.as_py(), block.known)
                if not counts:
                    continue
                ids.append(doc_id.as_py())
                sizes.append(size)
                held.append(counts)
                n += len(counts)
                if len(ids) == segment_docs or n >= postings:
                    yield found(ids, sizes, held)
                    ids, sizes, held, n = [], [], [], 0
        if ids:
            yield found(ids, sizes, held)

    return trimmed(run)


def _blocks(items: DataFrame, block_words: int) -> Iterator[list]:
    """The items' rows (item_id, text), each once, in blocks of about as many characters as make ``block_words`` words, or of one longer text."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    rows = staged(rows.withColumns({"hash": F.xxhash64("text"), "size": F.length("text") + 1}), "items")
    summed = staged(table_sums(rows, [F.col("item_id"), F.col("hash")], {"before": F.col("size")}), "blocks")
    cut = staged(summed.withColumn("block", F.floor(F.col("before") / (6 * block_words))), "blocks")
    for b in sorted(r["block"] for r in cut.select("block").distinct().collect()):
        yield cut.filter(F.col("block") == b).orderBy("item_id", "hash").select("item_id", "text").collect()


def rank(spark: SparkSession, docs: DataFrame, items: DataFrame, top: int = TOP, segment_docs: int = DOCS, postings: int = POSTINGS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents (doc_id, text) of every item (item_id, text), as far as they score above 0."""
    rows, found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), []
    for number, asked in enumerate(_blocks(items, block_words)):
        block = Block([r["text"] for r in asked])
        n, words, held = statistics(docs, block.known)
        if not (n and block.known):
            continue
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(asked)], "item long, item_id long")
        best = staged(rows.mapInArrow(_search(block, weights(n, held), n, words, top, segment_docs, postings), "item long, doc_id long, score long"), "best")
        nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        ranked = best.withColumn("rank", nth).filter(F.col("rank") <= top)
        # As many names as the block has items.
        found.append(ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score").withColumn("block", F.lit(number)))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionAll, found).drop("block")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH word AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
size AS (SELECT doc_id, count(*) AS n FROM word GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM size),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
held AS (SELECT doc_id, term, count(*) AS tf FROM word WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM held, whole GROUP BY term),
impact AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))) AS impact FROM held JOIN weight USING (term) JOIN size USING (doc_id), whole),
scored AS (SELECT item_id, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM asked JOIN impact USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

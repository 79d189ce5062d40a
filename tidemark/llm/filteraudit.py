"""How five text filters interact, audited with radix tries for the duplicate filter.

Every document has a mask of the filters it fails:

    A  under 200 words                    B  distinct words under half of the words
    C  A-Z over 3 % of the code points    D  any of # $ % & * |
    E  the same text stands under a smaller doc_id anywhere in the table

Words are runs of anything but space and \\x09-\\x0D.  A to D come from the text alone.  For E
a task first folds the texts it meets: of equal texts only the smallest doc_id goes on with the
text, all others fail E for certain, so a text that fills a third of the table crosses the
shuffle about once a task.  What is left is range-partitioned by adaptive prefixes: by its
first ``HEAD`` bytes, and where more than ``SHARED`` bytes have a prefix in common, by one of
twice that length, and so on, so that a passage at the top of many texts does not put them into
one task.  A partition's whole texts are inserted into a compressed trie, whose terminals hold
the smallest doc_id; walking the terminals gives the flags.

Masks are then reduced to counts by part, mask and labels, at most 128 a part, from which every
order of the filters follows: a document is removed by the first filter of the order that it
fails.  Of all 120 orders, a filter is the first of k failed ones in 120 / k.

Null and empty texts are empty and equal.  A null doc_id is neither smaller nor larger than
another one, so E passes and no label is found; equal rows of one doc_id do not fail E for each
other.  A doc_id labelled twice is good or toxic if any of its labels says so.  A null lang is
the empty part.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, texts_of

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
_CAPITALS = bytes(range(65, 91))
_SIGNS = re.compile(rb"[#$%&*|]")
COPY = 1 << FILTERS.index("E")
#: Bytes of texts that a task folds at a time, that a partition of tries takes, and that may share a prefix; bytes of the first prefix.
FOLD, PARTITION, SHARED, HEAD = 32 << 20, 16 << 20, 1 << 20, 16
#: Prefixes that are shared by more are at most this many a round, whatever the size of the table.
BRANCHES = 1024


def mask_of(text: str, raw: bytes) -> int:
    """The bits of A to D."""
    words = raw.split()
    return ((len(words) < LEAST_WORDS) | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
            | (100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > CAPITAL_PERCENT * len(text)) << 2 | bool(_SIGNS.search(raw)) << 3)


class Trie:
    """A compressed trie of byte strings; a terminal holds the smallest key and the rows of its text."""

    def __init__(self):
        self.edges: list[dict[int, tuple[bytes, int]]] = [{}]
        self.held: dict[int, tuple[object, list[int]]] = {}

    def _node(self) -> int:
        self.edges.append({})
        return len(self.edges) - 1

    def insert(self, text: bytes, key, row: int) -> None:
        node, at, end = 0, 0, len(text)
        while at < end:
            edges = self.edges[node]
            edge = edges.get(text[at])
            if edge is None:
                new = self._node()
                edges[text[at]] = text[at:], new
                node, at = new, end
                continue
            label, child = edge
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            shared = _shared(label, text, at)
            middle = self._node()
            edges[text[at]] = label[:shared], middle
            self.edges[middle][label[shared]] = label[shared:], child
            node, at = middle, at + shared
        least, rows = self.held.get(node, (key, []))
        rows.append(row)
        self.held[node] = min(least, key), rows

    def terminals(self) -> Iterator[tuple[object, list[int]]]:
        """Smallest key and rows of every text, from the root down."""
        stack = [0]
        while stack:
            node = stack.pop()
            if node in self.held:
                yield self.held[node]
            stack.extend(child for _, child in self.edges[node].values())


def _shared(label: bytes, text: bytes, at: int) -> int:
    """Length of the common start of a label and the text from ``at``; they differ somewhere in the label."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == text[at + low:at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class _Rows:
    """Result rows of a task: doc_id, part, mask, how many, and the text where E is still open."""

    def __init__(self, kind: pa.DataType):
        self.kind, self.lists = kind, ([], [], [], [], [])

    def add(self, *row) -> None:
        for held, x in zip(self.lists, row):
            held.append(x)

    def batch(self) -> pa.RecordBatch:
        kinds = (self.kind, pa.string(), pa.int32(), pa.int64(), pa.binary())
        out = pa.record_batch([pa.array(x, k) for x, k in zip(self.lists, kinds)], ["doc_id", "part", "mask", "n", "text"])
        self.lists = ([], [], [], [], [])
        return out


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Masks of documents; texts only for the smallest doc_id of equal texts met together."""
    held: dict[bytes, list] = {}  # text: mask, doc_id, rows by part
    size, rows = 0, None

    def flush() -> Iterator[pa.RecordBatch]:
        least = 0
        for raw, (mask, key, parts) in held.items():
            for part, n in parts.items():
                rows.add(key, part, mask, n, raw)
            least += len(raw)
            if least > 1 << 22:
                yield rows.batch()
                least = 0
        held.clear()
        yield rows.batch()
    for batch in batches:
        rows = rows or _Rows(batch.column("doc_id").type)
        for key, part, text in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), texts_of(batch)):
            raw = text.encode()
            known = held.get(raw)
            mask = known[0] if known else mask_of(text, raw)
            if key is None:
                rows.add(None, part, mask, 1, None)
            elif known is None:
                held[raw] = [mask, key, {part: 1}]
                size += len(raw)
            elif key > known[1]:
                rows.add(key, part, mask | COPY, 1, None)
            elif key == known[1]:
                known[2][part] = known[2].get(part, 0) + 1
            else:
                for p, n in known[2].items():
                    rows.add(known[1], p, mask | COPY, n, None)
                known[1:] = key, {part: 1}
        if size > FOLD:
            yield from flush()
            size = 0
        elif rows.lists[0]:
            yield rows.batch()
    if held:
        yield from flush()


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a partition, E decided by the trie of its texts."""
    trie, ids, parts, masks, counts, kind = Trie(), [], [], [], [], None
    for batch in batches:
        kind = batch.column("doc_id").type
        keys = batch.column("doc_id").to_pylist()
        for i, raw in enumerate(batch.column("text")):
            trie.insert(raw.as_py(), keys[i], len(ids) + i)
        ids += keys
        for held, name in ((parts, "part"), (masks, "mask"), (counts, "n")):
            held += batch.column(name).to_pylist()
    if not ids:
        return
    for least, rows in trie.terminals():
        for i in rows:
            if ids[i] > least:
                masks[i] |= COPY
    yield pa.record_batch([pa.array(ids, kind), pa.array(parts, pa.string()), pa.array(masks, pa.int32()), pa.array(counts, pa.int64())], ["doc_id", "part", "mask", "n"])


def _prefix(size: int) -> Column:
    return F.xxhash64(F.substring("text", 1, size))


def shared_prefixes(texts: DataFrame, most: int) -> list[tuple[int, list[int]]]:
    """(length, hashes of the prefixes of that length under which more than ``most`` bytes lie), shortest first.

    A round returns no more hashes than the bytes of all texts hold ``most``.
    """
    found, size, left = [], HEAD, texts.select("text")
    while True:
        longer = left.where(F.length("text") > size)
        hashes = [r["key"] for r in longer.groupBy(_prefix(size).alias("key")).agg(F.sum(F.length("text")).alias("bytes")).where(F.col("bytes") > most).collect()]
        if not hashes:
            return found
        found.append((size, hashes))
        left = longer.where(_prefix(size).isin(hashes))
        size *= 2


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n): what every document fails; ``n`` equal rows of a document may be one."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    rows = cut(source.mapInArrow(_folded, f"doc_id {kind}, part string, mask int, n long, text binary"))
    open_rows = rows.where(F.col("text").isNotNull())
    total = open_rows.agg(F.sum(F.length("text"))).first()[0] or 0
    branch = F.lit(0).cast("long")
    for size, hashes in shared_prefixes(open_rows, max(SHARED, total // BRANCHES)):
        branch = F.when((F.length("text") > size) & _prefix(size).isin(hashes), _prefix(2 * size)).otherwise(branch)
    dealt = open_rows.withColumn("head", F.substring("text", 1, HEAD)).withColumn("branch", branch).repartitionByRange(max(1, -(-total // PARTITION)), "head", "branch")
    decided = dealt.select("doc_id", "part", "mask", "n", "text").mapInArrow(_flagged, f"doc_id {kind}, part string, mask int, n long")
    return decided.unionByName(rows.where(F.col("text").isNull()).drop("text"))


def counts(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n) of masks; the labels are joined to rows summed by document."""
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    known = known.where(F.col("good") | F.col("toxic"))
    docs = found.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return docs.join(known, "doc_id", "left").groupBy("part", "mask", flag("good"), flag("toxic")).agg(F.sum("n").alias("n"))


def report(cells: DataFrame) -> DataFrame:
    """Every order and step of every part, from counts by mask."""
    steps = [{"filter_order": "".join(order), "step": k + 1, "bit": 1 << FILTERS.index(order[k]), "before": sum(1 << FILTERS.index(f) for f in order[:k])}
             for order in permutations(FILTERS) for k in range(len(order))]
    kind = "array<struct<filter_order:string,step:int,bit:int,before:int>>"
    rows = cells.select("*", F.explode(F.from_json(F.lit(json.dumps(steps)), kind)).alias("s")).select("part", "mask", "good", "toxic", "n", "s.*")
    gone, fails = (F.col("mask").bitwiseAND(F.col("before")) != 0), (F.col("mask").bitwiseAND(F.col("bit")) != 0)
    count = lambda where, of=F.col("n"): F.coalesce(F.sum(F.when(where, of)), F.lit(0)).cast("long")
    lost = ~gone & fails
    return rows.groupBy("part", "filter_order", "step").agg(
        count(~gone & ~fails).alias("kept"), count(lost).alias("removed"), count(gone & fails).alias("redundant"), count(F.col("mask") == F.col("bit")).alias("unique_fails"),
        count(lost & F.col("good")).alias("good_lost"), count(lost & F.col("toxic")).alias("toxic_lost"),
        count(fails, F.col("n") * F.floor(F.lit(120) / F.greatest(F.bit_count("mask"), F.lit(1)))).alias("shapley"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return report(counts(masks(docs), labels))


SQL = r"""
with texts as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
words as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from texts),
fails as (
    select doc_id, part, len(w) < 200 as a, 100 * len(list_distinct(w)) < 50 * len(w) as b,
           100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) as c, regexp_matches(t, '[#$%&*|]') as d,
           coalesce(doc_id > min(doc_id) over (partition by t), false) as e from words),
known as (select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic from labels where doc_id is not null group by doc_id),
cells as (
    select part, [a, b, c, d, e] as f, coalesce(good, false) as good, coalesce(toxic, false) as toxic, count(*) as n
    from fails left join known using (doc_id) group by all),
letter as (select unnest(['A', 'B', 'C', 'D', 'E']) as l),
orders as (
    select p.l || q.l || r.l || s.l || t.l as filter_order from letter p, letter q, letter r, letter s, letter t
    where len(list_distinct([p.l, q.l, r.l, s.l, t.l])) = 5),
steps as (select filter_order, k::int as step, filter_order[k] as l, left(filter_order, k - 1) as before from orders, range(1, 6) r(k)),
seen as (
    select part, filter_order, step, l, n, good, toxic, f[ascii(l) - 64] as bad,
           len(list_filter(range(1, step), lambda i: f[ascii(before[i]) - 64])) > 0 as gone,
           len(list_filter(f, lambda x: x)) as failed
    from cells, steps),
sums as (
    select part, filter_order, step, l, coalesce(sum(n) filter (where not gone and not bad), 0)::bigint as kept,
           coalesce(sum(n) filter (where not gone and bad), 0)::bigint as removed, coalesce(sum(n) filter (where gone and bad), 0)::bigint as redundant,
           coalesce(sum(n) filter (where bad and failed = 1), 0)::bigint as unique_fails,
           coalesce(sum(n) filter (where not gone and bad and good), 0)::bigint as good_lost,
           coalesce(sum(n) filter (where not gone and bad and toxic), 0)::bigint as toxic_lost
    from seen group by all)
select * exclude (l), (sum(removed) over (partition by part, l))::bigint as shapley from sums
"""

"""N-gram Jaccard join: subsets of small sets, inverted lists for large ones, groups by reachability."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import _ODD, _powers, blocks, components, doc_texts, gram_rows, grams, lowered, mix, staged, text_bytes, trimmed, words

LIST, NEAR, SUBSET = 0, 1, 2  # kinds of postings
#: Shingles a task counts at a time to find common ones; beyond it those met least are forgotten.
_COUNTED = 1_000_000


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and 63-bit hash of the distinct shingles of every row, by row and hash.

    A row with fewer words than `size` has its whole sequence as one shingle; one without words has none.
    """
    _, _, word, before = words(lowered(data), at)
    which, row = gram_rows(before, size)
    token = grams(word, size)[which] >> np.uint64(1)
    count = np.diff(before)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        powers, inverse = _powers(len(word).bit_length())
        total = np.zeros(len(word) + 1, np.uint64)
        np.cumsum(word * powers[: len(word)], out=total[1:])
        first, last = before[:-1][short], before[1:][short]
        whole = mix((total[last] - total[first]) * inverse[first] + count[short].astype(np.uint64) * _ODD)
        token, row = np.concatenate([token, whole >> np.uint64(1)]), np.concatenate([row, short])
    return _distinct(row, token)


def _distinct(row: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = _order(row, token)
    row, token = row[order], token[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
    return row[new], token[new]


def _order(row: np.ndarray, token: np.ndarray) -> np.ndarray:
    order = np.argsort(token)
    kind = np.uint16 if not len(row) or row.max() < 65536 else np.int64
    return order[np.argsort(row[order].astype(kind), kind="stable")]


def set_keys(row: np.ndarray, token: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Size of every row's set and a hash of it that does not depend on order; 0 for an empty set."""
    size = np.bincount(row, minlength=n_rows)
    key = np.zeros(n_rows, np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        key[some] = mix(np.add.reduceat(mix(token + np.uint64(1)), first[some]) + size[some].astype(np.uint64) * _ODD)
    return size, key.view(np.int64)


def counted_on(token: np.ndarray, count: np.ndarray, more: np.ndarray, most: int = _COUNTED) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes and how often each was met, after `more`; the rarest go while there are over `most`."""
    new, times = np.unique(more, return_counts=True)
    at = np.searchsorted(token, new)
    known = at < len(token)
    known[known] = token[at[known]] == new[known]
    count[at[known]] += times[known]
    token = np.insert(token, at[~known], new[~known])
    count = np.insert(count, at[~known], times[~known])
    least = 1
    while len(token) > most:
        keep = count > least
        token, count, least = token[keep], count[keep], least + 1
    return token, count


def prefix_length(size: np.ndarray, percent: int, shared: int) -> np.ndarray:
    """Two sets that link share at least `shared` of so many first shingles in any common order."""
    return np.minimum(size, size - (percent * size + 99) // 100 + shared)


def boundary(sizes: list[tuple[int, int]], percent: int, *, scan_cost: float = 4.0, largest: int = 64) -> int:
    """Up to which size sets are to be joined by subsets of two.

    A set within the boundary costs its pairs of prefix shingles; one beyond it, or near enough below to
    link across, costs its prefix shingles times `scan_cost` (a list entry is met again when its list is
    scanned). The boundary with the least sum is taken.
    """
    if not sizes:
        return 0
    n = np.array([s for s, _ in sizes])
    count = np.array([c for _, c in sizes], float)
    two, one = prefix_length(n, percent, 2), prefix_length(n, percent, 1)
    costs = []
    for s in range(largest + 1):
        subsets = (count * two * (two - 1) / 2)[n <= s].sum()
        lists = (count * one * scan_cost)[n * 100 > percent * s].sum()
        costs.append(subsets + lists)
    return int(np.argmin(costs))


def groups(docs: DataFrame, *, size: int = 5, percent: int = 75, max_common: int = 500_000, common_in_task: int = 3) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Two documents link when 100 * intersection >= percent * union of their sets of shingles. Equal sets
    are one class from the start. The join is exact: a size-aware heavy-light join over prefixes of the
    sets in one global order, hash order with common shingles last. The list of common ones is bounded
    (`max_common` hashes, counted over all documents) and only steers the order, so what it misses costs
    time, not links.

    * Sets up to a boundary chosen by cost enumerate all pairs of their prefix; two small sets that link
      share a pair. Larger ones post each prefix shingle; sets near the boundary do both, so that small
      and large sets meet.
    * First each set is verified, on the whole texts, against the one it shares most lists with as their
      smallest member; that joins groups of copies with one pair a set. Then pairs in a list whose
      members are not connected yet, and that the size and position filters cannot exclude, are
      verified too.

    Null text and text without words link with nothing. Repeated rows are classes of their own text; a
    null doc_id is kept and is nobody's component. An empty table gives none; other columns are ignored.
    """
    rows = doc_texts(docs)

    def sets_of(b: pa.RecordBatch):
        data, at = text_bytes(b.column("text"))
        for i, j in blocks(at):
            row, token = shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], size)
            yield i, j, row, token, *set_keys(row, token, j - i)

    def surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        counted, counts = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        for b in batches:
            keys, sizes, tokens = [], [], []
            for _, _, row, token, n, key in sets_of(b):
                keys.append(key)
                sizes.append(n)
                fresh = np.array([k not in seen and not seen.add(k) for k in key.tolist()], bool)
                tokens.append(token[fresh[row]])
            if not keys:
                continue
            key, n = np.concatenate(keys), np.concatenate(sizes)
            yield pa.record_batch({"of": pa.array(np.zeros(len(key), np.int8)), "id": b.column("doc_id"), "key": pa.array(key), "n": pa.array(n.astype(np.int64))})
            counted, counts = counted_on(counted, counts, np.concatenate(tokens))
        often = counts >= common_in_task
        one, zero = np.ones(often.sum(), np.int8), np.zeros(often.sum(), np.int64)
        yield pa.record_batch({"of": pa.array(one), "id": pa.array(zero), "key": pa.array(counted[often].view(np.int64)), "n": pa.array(counts[often].astype(np.int64))})

    survey = staged(rows.mapInArrow(trimmed(surveyed), "of byte, id long, key long, n long"))
    members = survey.where("of = 0").select(F.col("id").alias("doc_id"), "key", "n")
    common = survey.where("of = 1").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(max_common).select("key").toPandas()
    sizes = members.where("n between 1 and 128").groupBy("n").count().orderBy("n").collect()
    small = boundary([(r[0], r[1]) for r in sizes], percent)
    spark = docs.sparkSession
    last = spark.sparkContext.broadcast(np.sort(common["key"].to_numpy(np.int64).view(np.uint64)))

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal sets of one task post once
        frequent = last.value
        for b in batches:
            for _, _, row, token, n, key in sets_of(b):
                fresh = np.array([k not in seen and not seen.add(k) for k in key.tolist()], bool) & (n > 0)
                use = fresh[row]
                row, token = row[use], token[use]
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, token), len(frequent) - 1)
                    token = token | ((frequent[at] == token).astype(np.uint64) << np.uint64(63))
                order = _order(row, token)
                row, token = row[order], token[order]
                first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))])[:-1]
                place = np.arange(len(row)) - first[row]
                size_of = n[row]
                big = size_of > small
                lists = (place < prefix_length(size_of, percent, 1)) & (100 * size_of > percent * small)
                yield _postings(token[lists], key[row[lists]], size_of[lists], place[lists], np.where(big[lists], LIST, NEAR))
                pairs = (place < prefix_length(size_of, percent, 2)) & ~big
                yield _subsets(row[pairs], token[pairs], key, n)

    postings = rows.mapInArrow(trimmed(posted), "token long, key long, packed long")
    # Frequent shingles (negative tokens) are combined before they are shuffled and joined back, which
    # adaptive execution can split; the many others are grouped where they meet.
    low, high, many = F.min("key"), F.max("key"), F.count("*")
    of_token = Window.partitionBy("token")
    rare = postings.where("token >= 0").select("*", low.over(of_token).alias("low"), high.over(of_token).alias("high"), many.over(of_token).alias("many"))
    often = postings.where("token < 0")
    often = often.join(often.groupBy("token").agg(low.alias("low"), high.alias("high"), many.alias("many")), "token").select(rare.columns)
    shared = staged(rare.where("low <> high").unionByName(often.where("low <> high")).drop("low", "high"))
    size_of, place, kind = F.shiftright("packed", 32), F.shiftright("packed", 2).bitwiseAND((1 << 30) - 1), F.col("packed").bitwiseAND(3)

    classes = members.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    # The head of a list is the member that meets most others; where copies were edited, that is what
    # they were made of. Each class goes with the head it shares most lists with.
    ranked = shared.join(shared.groupBy("key").agg(F.sum("many").alias("degree")), "key").select("token", "key", "packed", "degree")
    heads = ranked.groupBy("token").agg(F.max(F.struct("degree", "key"))["key"].alias("head"))
    stars = ranked.join(heads, "token").where("head <> key").groupBy("head", "key").agg(F.count("*").alias("met"), F.max(size_of).alias("n"))
    likely = stars.where(F.col("met") * 1200 >= F.col("n") * (100 - percent)).groupBy("key").agg(F.max_by("head", F.struct("met", "head")).alias("head"))
    found = staged(_verified(rows, classes, likely.select(F.col("head").alias("a"), F.col("key").alias("b")), size, percent))

    label = components(found)
    spread = shared.select("token", "key", size_of.alias("n"), place.alias("place"), kind.alias("kind")).join(label.withColumnRenamed("node", "key"), "key", "left")
    spread = staged(spread.withColumn("component", F.coalesce("component", "key")))
    open_ = spread.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    spread = spread.join(open_, "token", "left_semi")
    a, b = spread.alias("a"), spread.alias("b")
    within = 100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")
    both = F.col("a.n") + F.col("b.n")
    # At their first common shingle, what remains behind it must suffice for the overlap.
    rest = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    can = (F.col("a.kind") == SUBSET) | (rest * (100 + percent) >= percent * both)
    pair = (F.col("a.token") == F.col("b.token")) & (F.col("a.component") < F.col("b.component")) & within & can
    across = a.join(b, pair & ((F.col("a.kind") + F.col("b.kind")) != 2 * NEAR)).select(F.least("a.key", "b.key").alias("a"), F.greatest("a.key", "b.key").alias("b")).distinct()
    found = found.unionByName(_verified(rows, classes, across.join(found, ["a", "b"], "left_anti"), size, percent))

    ids = lambda c: classes.select(F.col("key").alias(c), F.col("doc_id").alias(f"doc_{c}"))
    links = found.join(ids("a"), "a").join(ids("b"), "b").select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))
    whole = classes.join(components(links), F.col("doc_id") == F.col("node"), "left").select("key", F.coalesce("component", "doc_id").alias("component_id"))
    joined = members.join(whole, "key", "left")
    own = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def _postings(token: np.ndarray, key: np.ndarray, n: np.ndarray, place: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    packed = (n.astype(np.int64) << 32) | (place.astype(np.int64) << 2) | kind
    return pa.record_batch({"token": pa.array(token.view(np.int64)), "key": pa.array(key), "packed": pa.array(packed)})


def _subsets(row: np.ndarray, token: np.ndarray, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Every pair of shingles of each row's extended prefix, as one hash."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, int(np.bincount(row).max(initial=0))):
        at = np.flatnonzero(row[step:] == row[:-step])
        left.append(at)
        right.append(at + step)
    i, j = np.concatenate(left), np.concatenate(right)
    often = token[i] & token[j] & np.uint64(1 << 63)
    pair = (mix(token[i] * _ODD + token[j]) >> np.uint64(1)) | often
    owner = row[i]
    zero = np.zeros(len(i), np.int64)
    return _postings(pair, key[owner], n[owner], zero, zero + SUBSET)


def _verified(rows: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs a, b of classes whose sets link, by the whole texts of one document each."""
    pairs = staged(pairs)
    wanted = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct().join(classes, "key")

    def right_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = text_bytes(b.column("text"))
            good = [np.zeros(0, bool)]
            for i, j in blocks(at):
                row, token = shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], size)
                good.append(set_keys(row, token, j - i)[1] == b.column("key").to_numpy()[i:j])
            yield b.select(["key", "text"]).filter(pa.array(np.concatenate(good)))

    texts = rows.join(wanted, "doc_id").select("key", "text").mapInArrow(trimmed(right_one), "key long, text string").dropDuplicates(["key"])
    side = lambda c: texts.select(F.col("key").alias(c), F.col("text").alias(f"text_{c}"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            data_a, at_a = text_bytes(b.column("text_a"))
            data_b, at_b = text_bytes(b.column("text_b"))
            for i, j in blocks(at_a + at_b):
                row_a, token_a = shingle_sets(data_a[at_a[i] : at_a[j]], at_a[i : j + 1] - at_a[i], size)
                row_b, token_b = shingle_sets(data_b[at_b[i] : at_b[j]], at_b[i : j + 1] - at_b[i], size)
                row, token = np.concatenate([row_a, row_b]), np.concatenate([token_a, token_b])
                order = _order(row, token)
                row, token = row[order], token[order]
                twice = (row[1:] == row[:-1]) & (token[1:] == token[:-1])
                both = np.bincount(row[1:][twice], minlength=j - i)
                total = np.bincount(row, minlength=j - i) - both
                kept.append(100 * both >= percent * total)
            good = np.concatenate(kept) if kept else np.zeros(0, bool)
            yield b.select(["a", "b"]).filter(pa.array(good))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(trimmed(compared), "a long, b long")


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest id.

    Of rows that repeat id and text one stays. Rows without id stay if one of them heads a group.
    """
    heads = groups(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias("head_")).agg(F.count("*").alias("rows_"))
    stay = docs.join(staged(heads), F.col("doc_id").cast("long").eqNullSafe(F.col("head_"))).drop("head_")
    once = stay.where("rows_ > 1").withColumn("text_", F.xxhash64("doc_id", "text")).dropDuplicates(["doc_id", "text_"]).drop("text_")
    return stay.where("rows_ = 1").unionByName(once).drop("rows_")

"""MinHash near-dedup (operator 10): BagMinHash signatures, banding, and verified multiset overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernel, work

#: Words of a shingle and the weighted Jaccard similarity from which texts are near-duplicates.
SHINGLE, SIMILAR = 5, 0.8
#: A pair at the threshold shares no band with probability (1 - 0.8**5)**32 = 3e-6.
BANDS, BAND_ROWS = 32, 5
#: Members of a bucket that one task compares with as many others at once.
CHUNK = 1024
#: Ids of documents to drop up to which they are broadcast (about 20 bytes each).
LOOSE_ROWS = 500_000
#: Text keys up to which the table of texts to verify is broadcast (about 60 bytes each).
BROADCAST_ROWS = 100_000
#: Bits that bound how many dyadic intervals a weight's axis is cut into.
MOST_LEVELS = 40

_U = np.uint64
_UNIT = 1.0 / (1 << 53)


def shingles(column: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, times): the multiset of word n-grams of each text, sorted by text and shingle.
    A text of fewer words than n has one shingle, all of its words; a text of none has the empty one."""
    w = kernel.words(column)
    gram, text = kernel.ngrams(w.hashes(), w.first, n, whole=True)
    order = np.lexsort((gram, text))
    gram, text = gram[order], text[order]
    new = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])]) if len(gram) else np.zeros(0, np.int64)
    return text[new], gram[new], np.diff(np.r_[new, len(gram)])


def _draw(key: np.ndarray, salt: int) -> np.ndarray:
    return kernel.mix(key + _U((salt * 0x9E3779B97F4A7C15) % (1 << 64)))


def bag_minhash(text: np.ndarray, gram: np.ndarray, times: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """BagMinHash signatures, one row of m arrival times for each text.

    Every shingle owns Poisson processes of rate 1 on its weight axis.  The axis is cut into the dyadic
    intervals (0,1], (1,2], (2,4], ...; each is one process of rate equal to its length, and the process
    of an interval is the sum of those of its halves down to single weights: every bit of a point's
    draw sends it into one half, until its weight is known.  Points carry that weight, a register and
    an arrival time.  A point counts for a text whose weight reaches the point's, and a register keeps
    its earliest point, so equal registers of two texts have the probability of their weighted Jaccard
    similarity.  Points come in ascending time and end at the text's limit, by which all registers are
    full but rarely; texts with an empty register are drawn again up to twice the limit.
    """
    out = np.full(n_texts * m, np.inf)
    total = np.bincount(text, times, n_texts)
    limit = np.zeros(n_texts)
    limit[total > 0] = m * (np.log(m) + 1.5) / total[total > 0]
    level = np.zeros(len(text), np.int64)  # of the process (2**(level-1), 2**level]; level 0 is (0, 1]
    tops = np.ceil(np.log2(times)).astype(np.int64)
    if tops.max(initial=0):
        size = np.minimum(tops, MOST_LEVELS) + 1
        at = np.repeat(np.arange(len(text)), size)
        level = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        text, gram, times = text[at], gram[at], times[at]
    length = np.where(level == 0, 1, 1 << np.maximum(level - 1, 0)).astype(np.float64)
    base = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    key = kernel.mix(_draw(gram, 1) + level.astype(_U))
    todo = np.arange(len(text))
    while len(todo):
        live, now, step = todo, np.zeros(len(todo)), 0
        while len(live):
            step += 1
            draw = _draw(key[live], 2 * step)
            now = now - np.log(((draw >> _U(11)).astype(np.float64) + 0.5) * _UNIT) / length[live]
            on = now <= limit[text[live]]
            live, now, draw = live[on], now[on], draw[on]
            other = _draw(draw, 3)
            register = ((other >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
            high = level[live] > 1  # intervals longer than 1 hold more than one weight
            seen = np.ones(len(live), bool)
            if high.any():
                where = base[live[high]] + 1 + ((other[high] & _U(0xFFFFFFFF)).astype(np.float64) / 2**32 * length[live[high]]).astype(np.int64)
                seen[high] = where <= times[live[high]]
            np.minimum.at(out, text[live[seen]] * m + register[seen], now[seen])
        empty = np.isinf(out.reshape(n_texts, m)).any(axis=1) & (total > 0)
        if not empty.any():
            break
        limit = np.where(empty, limit * 2, 0)
        todo = np.flatnonzero(empty[text])
    return out.reshape(n_texts, m)


def _sign(bands: int, rows: int, shingle: int):
    m = bands * rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in kernel.blocks(batch.column(1)):
                text, gram, times = shingles(batch.column(1).slice(a, b - a), shingle)
                bits = np.ascontiguousarray(bag_minhash(text, gram, times, b - a, m)).view(_U)
                mixed = kernel.mix(bits)
                band = np.zeros((b - a, bands), _U)
                for r in range(rows):
                    band = kernel.mix(band * _U(31) + mixed[:, r::rows] + _U(r))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * bands), pa.array(band.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["text_key", "bands"])
            kernel.release()

    return sign


def _grams(shingle: int):
    """Texts to their multisets as sets: each repeat of a shingle is an element of its own, so the size
    of an intersection is the sum of the lesser counts."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in kernel.blocks(batch.column(1)):
                text, gram, times = shingles(batch.column(1).slice(a, b - a), shingle)
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                element = kernel.mix(np.repeat(gram, times) + nth.astype(_U) * _U(0x9E3779B97F4A7C15))
                first = np.r_[0, np.cumsum(np.bincount(text, times, b - a))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(first), pa.array(element.view(np.int64)))], ["text_key", "grams"])
            kernel.release()

    return grams


def _overlap(a: str, b: str, least: float) -> Column:
    """Whether two multisets have a weighted Jaccard similarity of ``least`` or more."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both) >= least


def _similar(pairs: DataFrame, wanted: DataFrame, least: float) -> DataFrame:
    """(a, b, similar) for pairs of text keys, by the exact weighted Jaccard of their texts."""
    one = wanted.select(F.col("text_key").alias("ka"), F.col("grams").alias("ga"))
    two = wanted.select(F.col("text_key").alias("kb"), F.col("grams").alias("gb"))
    both = pairs.join(two, F.col("b") == F.col("kb")).select("a", "b", "gb").join(one, F.col("a") == F.col("ka"))
    return both.select("a", "b", _overlap("ga", "gb", least).alias("similar"))


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root): the least node that each node of the links (a, b) is connected to.

    Labels spread over the links and jump to their label's label until nothing changes; each round is
    a written table, and only whether something changed reaches the driver.  ``rows``: a bound of the
    links' number, counted if it is not given.
    """
    rows = 2 * (links.count() if rows is None else rows)
    both = work.written(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", rows=rows)
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root"))
    while True:
        start = labels
        for _ in range(2):  # two steps to a table
            near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
            spread = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("root", F.coalesce("near", "root")).alias("next"))
            jump = spread.select(F.col("node").alias("j"), F.col("next").alias("jump"))
            labels = spread.join(jump, F.col("next") == F.col("j"), "left").select("node", F.least("next", F.coalesce("jump", "next")).alias("root"))
        was = start.select(F.col("node").alias("w"), F.col("root").alias("was"))
        moved = work.written(labels.join(was, F.col("node") == F.col("w")).select("node", "root", "was"), "labels", rows=rows)
        labels = moved.select("node", "root")
        if moved.where(F.col("root") != F.col("was")).isEmpty():
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR, shingle: int = SHINGLE) -> DataFrame:
    """(id, class_id, n_copies): one row per row of ``docs``.

    Texts are nodes, whatever rows hold them: equal texts are one node.  Two nodes are linked if their
    word-shingle multisets have a weighted Jaccard similarity of ``least`` or more; classes are the
    connected groups of links.  ``class_id`` is the least id in the class, ``n_copies`` the rows with
    the same text.

    A null text is a class of its own with its own id; texts without words equal each other; a class
    whose ids are all null has a null class_id.  Repeated rows fall into one class; other columns are
    not read.

    Every pair of nodes that shares a band is compared, or connected already: each member of a bucket
    with the bucket's least member, then those that differ from it with all other members.
    The second comparison gives a row only for a link between different components, so no bucket is
    ever emitted as pairs; its time is members that differ times members.
    """
    key = F.md5(F.col(text_col).cast("binary"))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("text_key"))
    with work.scratch():
        classed = _classes(docs, rows, key, text_col, least, shingle)
    out = rows.join(classed, F.col("text_key") == F.col("c_key"), "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("text_key").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def _classes(docs: DataFrame, rows: DataFrame, key: Column, text_col: str, least: float, shingle: int) -> DataFrame:
    """(c_key, n_copies, class_id): the class of each text key."""
    texts = docs.where(F.col(text_col).isNotNull()).select(key.alias("text_key"), F.col(text_col).alias("text"))

    signed = texts.mapInArrow(_sign(BANDS, BAND_ROWS, shingle), "text_key string, bands array<bigint>")
    signed = work.written(signed.groupBy("text_key").agg(F.first("bands").alias("bands")), "signatures")
    nodes = signed.select("text_key", F.posexplode("bands").alias("band", "h"))
    buckets = nodes.groupBy("band", "h").agg(F.min("text_key").alias("head"), F.count("*").alias("n")).where("n > 1").select(F.col("band").alias("hb"), F.col("h").alias("hh"), "head")
    members = work.written(nodes.join(buckets, (F.col("band") == F.col("hb")) & (F.col("h") == F.col("hh"))).select("text_key", "band", "h", "head"), "members")
    n = members.count()  # from the table's footers; no table of links has more rows

    stars = work.written(members.where(F.col("text_key") != F.col("head")).select(F.col("head").alias("a"), F.col("text_key").alias("b")).distinct(), "stars", rows=n)
    busy = work.written(stars.select(F.explode(F.array("a", "b")).alias("k")).distinct(), "busy", rows=2 * n)
    one = lambda t: t.groupBy("text_key").agg(F.first("text").alias("text"))
    is_busy = F.col("text_key") == F.col("k")
    if busy.count() <= BROADCAST_ROWS:  # else copies are folded before the join, so no key is hot in it
        wanted = one(texts.join(F.broadcast(busy), is_busy, "left_semi"))
    else:
        wanted = one(texts).join(busy, is_busy, "left_semi")
    wanted = work.written(wanted.select("text_key", "text").mapInArrow(_grams(shingle), "text_key string, grams array<bigint>"), "grams")

    done = work.written(_similar(stars, wanted, least), "verified")
    links = done.where("similar").select("a", "b")
    roots = components(links, n)
    # members that differ from a head meet the other members of that bucket
    failed = work.written(_apart(done.where("not similar").select("a", "b"), roots), "failed", rows=n)
    if not failed.isEmpty():
        met = work.written(_meet(members, failed, roots, wanted, least), "met")
        if not met.isEmpty():
            roots = components(links.unionAll(met), n + met.count())

    copies = rows.where(F.col("text_key").isNotNull()).groupBy("text_key").agg(F.count("*").alias("n_copies"), F.min("id").alias("least_id"))
    classed = copies.join(roots, F.col("text_key") == F.col("node"), "left").select(F.col("text_key").alias("c_key"), "n_copies", "least_id", F.coalesce("root", "text_key").alias("root"))
    classed = work.written(classed, "classes")
    names = classed.groupBy("root").agg(F.min("least_id").alias("class_id")).withColumnRenamed("root", "n_root")
    return work.written(classed.join(names, F.col("root") == F.col("n_root")).select("c_key", "n_copies", "class_id"), "classed", keep=True)


def _meet(members: DataFrame, failed: DataFrame, roots: DataFrame, wanted: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between components that a failed pair's member has inside the bucket it failed in.

    Every such member is compared with every other member of the bucket, exactly.  Large buckets fall
    into chunks on both sides, one task's work being a chunk against a chunk; of all links that a chunk
    pair holds between two components one comes out.
    """
    odd = members.join(failed, (F.col("head") == F.col("a")) & (F.col("text_key") == F.col("b"))).select("text_key", "band", "h")
    odd = work.written(odd, "odd", rows=members.count())
    size = odd.groupBy(F.col("band").alias("zb"), F.col("h").alias("zh")).agg(F.count("*").alias("n_odd"))
    here = (F.col("band") == F.col("zb")) & (F.col("h") == F.col("zh"))
    full = members.join(size, here).groupBy("zb", "zh").agg(F.count("*").alias("n_all"), F.first("n_odd").alias("n_odd"))
    full = work.written(full.select("zb", "zh", F.ceil(F.col("n_odd") / CHUNK).cast("int").alias("cx"), F.ceil(F.col("n_all") / CHUNK).cast("int").alias("cy")), "buckets", rows=members.count())

    def side(rows: DataFrame, own: str, other: str, is_odd: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("text_key"), F.col(own))
        spread = rows.join(full, here).select("text_key", "zb", "zh", mine.alias("m"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("o"))
        x, y = ("m", "o") if is_odd else ("o", "m")
        return spread.select(F.xxhash64("zb", "zh", F.col(x).cast("long"), F.col(y).cast("long")).alias("group"), F.lit(is_odd).alias("odd"), F.col("text_key").alias("key"))

    rows = side(odd, "cx", "cy", True).unionAll(side(members.select("text_key", "band", "h"), "cy", "cx", False))
    rows = rows.join(wanted, F.col("key") == F.col("text_key")).drop("text_key").join(roots, F.col("key") == F.col("node"), "left")
    rows = rows.select("group", "odd", "key", F.coalesce("root", "key").alias("root"), "grams")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            group = np.asarray(batch.column(0))
            if held and len(group) and held[-1]["group"][-1].as_py() != group[0]:
                yield from _links(pa.concat_tables(held), least)
                held = []
            cut = np.flatnonzero(group[1:] != group[:-1]) + 1
            for i, j in zip([0, *cut], [*cut, len(group)]):
                held.append(table.slice(i, j - i))
                if j < len(group):
                    yield from _links(pa.concat_tables(held), least)
                    held = []
        if held:
            yield from _links(pa.concat_tables(held), least)
        held = []
        kernel.release()

    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(meet, "a string, b string").distinct()


def _links(table: pa.Table, least: float) -> Iterator[pa.RecordBatch]:
    """One link for each two components that a row marked odd and another row of the table join."""
    odd = np.asarray(table["odd"].combine_chunks())
    root, label = np.unique(np.asarray(table["root"].to_pylist(), object).astype(str), return_inverse=True)
    if len(root) < 2 or not odd.any():
        return
    lists = table["grams"].combine_chunks()
    sizes = np.asarray(pa.compute.list_value_length(lists)).astype(np.int64)
    flat = np.asarray(lists.flatten())
    first = np.r_[0, np.cumsum(sizes)]
    theirs = np.flatnonzero(~odd)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    keep = ~odd[owner]
    order = np.argsort(flat[keep], kind="stable")
    gram, holder = flat[keep][order], owner[keep][order]
    found = set()
    for x in np.flatnonzero(odd):
        mine = flat[first[x] : first[x + 1]]
        low, high = np.searchsorted(gram, mine, "left"), np.searchsorted(gram, mine, "right")
        n = high - low
        at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        both = np.bincount(holder[at], minlength=len(sizes))[theirs]
        hit = theirs[(both / (sizes[x] + sizes[theirs] - both) >= least) & (label[theirs] != label[x])]
        found |= {(int(min(label[x], r)), int(max(label[x], r))) for r in np.unique(label[hit])}
    if found:
        a, b = zip(*sorted(found))
        yield pa.RecordBatch.from_arrays([pa.array(root[list(a)].astype(str).tolist(), pa.string()), pa.array(root[list(b)].astype(str).tolist(), pa.string())], ["a", "b"])


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose two sides are not in one component yet."""
    left = roots.select(F.col("node").alias("na"), F.col("root").alias("ra"))
    right = roots.select(F.col("node").alias("nb"), F.col("root").alias("rb"))
    both = pairs.join(left, F.col("a") == F.col("na"), "left").select("a", "b", F.coalesce("ra", "a").alias("ra")).join(right, F.col("b") == F.col("nb"), "left")
    return both.where(F.col("ra") != F.coalesce("rb", "b")).select("a", "b")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the row with the least id stays (rows
    that repeat that id stay as they are).  Rows with a null id or null text all stay."""
    classes = near_duplicates(docs, id_col, text_col, **limits)
    name = work.free_name(docs, "_loose")
    loose = classes.where(F.col(id_col) != F.col("class_id")).select(F.col(id_col).alias(name)).distinct()
    loose = work.written(loose, "loose")
    if loose.count() <= LOOSE_ROWS:
        loose = F.broadcast(loose)
    return docs.join(loose, F.col(id_col) == F.col(name), "left_anti")

"""Near copies by SimHash, pivot distance tables and exact verification: Jaccard similarity of 0.8 and more over sets of five-word shingles.

This is the near-dedup stage's form of operator 2. The operator's own fingerprints, blocks' groups and pivot tables come first:
texts whose 64 majority bits differ in up to four are candidates, and all of a cluster of them are compared as sets. Majority bits give no
bound on the similarity of sets, though, so a stage that owes 0.8 would lose links by them alone. What they leave apart is looked for
exactly: pairs of unlike clusters are found by groups of equal shingles, and ruled out by parity fingerprints only: the
parities of shingle counts in cells, 1,024 or as many as there are shingles, whose Hamming distance is at most the number of shingles that two sets don't share.

A pair of similarity 0.8 shares at least 0.8 of the shingles of each, so in any one order of all shingles it
shares one among the first fifth of each: the documents of such a shingle are a group (prefix filter). The order puts
shingles that are common in a sample last, which keeps groups small; it decides on speed alone. Most groups have the same members as
others, as near copies share many shingles; groups of equal members are made one. A large group of near copies, each with edits of its own,
would still stand in a group for each shingle: a first pass, by SimHash and by the least hashes of each set under four orders, finds what nearly all of its
links join, and the prefixes' groups then count only if they hold documents that aren't joined yet. Within a group, sizes, the table of distances to
reference fingerprints and then the parity fingerprints' own distance rule out pairs that can't reach 0.8. What is left is joined to
clusters, and within a cluster the sets themselves are compared in integers, so each link is a true one and none is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklight.llm.common import as_bytes, checkpoint, join_counted, letting_go, long, map_columns
from tracklight.llm.components import connected_components
from tracklight.llm.simhash import LINKS, SMALL, deal, fingerprint, gather, near_links, parts, tiles

#: Words in a shingle. The similarity is LEAST[0] / LEAST[1].
WORDS, LEAST = 5, (4, 5)
#: Least cells of a parity fingerprint; a larger set has the power of two from its size on.
CELLS = 1024
#: Factors of the orders of hashes whose least one is a key of the first pass.
ORDERS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)
#: Words of fingerprints that are looked at together, and shingles of a cluster's part.
AT_ONCE, CLUSTER_SHINGLES = 1 << 20, 1 << 20
#: Documents in the sample of which common shingles are taken, in how many of them these are, and the most that are kept.
SAMPLE, OFTEN, MOST = 4000, 3, 20_000
#: Documents of a group, and of a cluster, that one task compares with each other.
TILE, CLUSTER_TILE = 2048, 512
#: Reference fingerprints of a larger group: rows of its own, evenly spaced, so that what is near one is told from what is far.
PIVOTS = 8
#: Bits, and bits in one row, of the map of texts that are wanted; a row is what bitmap_construct_agg makes.
MAP, MAP_ROW = 1 << 24, 1 << 15


def shingles(text: bytes | None) -> np.ndarray:
    """The set of a text's shingles as sorted XXH64 of seed 42; a text of up to five words is one shingle, an empty one has none."""
    parts = text.lower().split() if text else []
    digest = xxhash.xxh64_intdigest
    if len(parts) <= WORDS:
        return np.array([digest(b" ".join(parts), 42)] if parts else [], np.uint64)
    grams = zip(*(parts[i:] for i in range(WORDS)), strict=False)
    return np.unique(np.fromiter((digest(b" ".join(s), 42) for s in grams), np.uint64, len(parts) - WORDS + 1))


def similar(shared, a, b):
    """Whether sets of a and b shingles, of which `shared` are common to both, reach the similarity; in integers."""
    return (LEAST[0] + LEAST[1]) * shared >= LEAST[0] * (a + b)


def prefix(own: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set, of which a similar set's first share one: rare ones by hash, then common ones by rank."""
    n = len(own)
    most = n - -(-n * LEAST[0] // LEAST[1]) + 1
    if not len(common):
        return own[:most]
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    often = common[at] == own
    first = own[~often][:most]
    if len(first) < most:
        rest = own[often][np.lexsort((own[often], rank[at[often]]))]
        first = np.concatenate([first, rest[: most - len(first)]])
    return first


def common_shingles(df: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of shingles that are common in a sample of distinct texts, and the rank of each: the commonest have the highest."""
    every = max(1, df.count() // SAMPLE)
    some = df.where(F.pmod(F.xxhash64(text), F.lit(every)) == 0).select(text).distinct()

    def run(batches):
        for batch in batches:
            sets = [shingles(x) for x in as_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64))], names=["h"])

    counts = some.mapInArrow(run, T.StructType([long("h")])).groupBy("h").count().where(F.col("count") >= OFTEN)
    rows = counts.orderBy(F.desc("count"), "h").limit(MOST).collect()
    hashes = np.array([r.h for r in rows], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.arange(len(rows), 0, -1)[order]


def parities(own: np.ndarray) -> bytes:
    """The parity fingerprint of a set: one of twice the cells, folded on itself, is that of half the cells."""
    n = max(CELLS, 1 << max(0, len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Fingerprints:
    """Parity fingerprints of rows, and distances of pairs of them."""

    def __init__(self, cells: list[bytes]):
        self.widths = np.array([len(x) // 8 for x in cells], np.int64)
        self.ends = np.cumsum(self.widths)
        self.flat = np.frombuffer(b"".join(cells), np.uint64)

    def rows(self, at: np.ndarray, width: int) -> np.ndarray:
        """Rows of one width, folded to half if that is what is wanted."""
        own = int(self.widths[at[0]])
        found = self.flat[(self.ends[at] - own)[:, None] + np.arange(own)]
        while own > width:
            own //= 2
            found = found[:, :own] ^ found[:, own:]
        return found

    def distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        both = np.stack([self.widths[a], self.widths[b]], axis=1)
        for pair in np.unique(both, axis=0):
            width = int(pair.min())
            which = np.flatnonzero((both == pair).all(axis=1))
            step = max(1, AT_ONCE // int(pair.max()))
            for start in range(0, len(which), step):
                x = which[start : start + step]
                out[x] = np.bitwise_count(self.rows(a[x], width) ^ self.rows(b[x], width)).sum(axis=1, dtype=np.int64)
        return out


def signatures(df: DataFrame, common: tuple[np.ndarray, np.ndarray], text: str = "text") -> DataFrame:
    """`df` without its text, with sig0, sig1 (equal for equal sets only), n, fp (operator 2's SimHash), cells (the parity sketch), least (keys of the first pass) and keys, the prefix."""

    def make():
        def run(column):
            sigs, sizes, prints, cells, least, keys = [], [], [], [], [], []
            for x in as_bytes(column):
                own = shingles(x)
                prints.append(fingerprint(x))
                sigs.append(np.frombuffer(xxhash.xxh128_digest(own.tobytes()), np.int64))
                sizes.append(len(own))
                cells.append(parities(own))
                least.append(np.array([(own * k).min() for k in ORDERS] if len(own) else [], np.uint64).view(np.int64))
                keys.append(prefix(own, *common).view(np.int64))
            sigs = np.array(sigs, np.int64).reshape(-1, 2)
            prints = np.array(prints, np.uint64).view(np.int64)
            return [*(np.ascontiguousarray(x) for x in sigs.T), sizes, prints, cells, *(pa.array(x, pa.list_(pa.int64())) for x in (least, keys))]

        return run

    fields = [*map(long, ("sig0", "sig1", "n", "fp")), T.StructField("cells", T.BinaryType())]
    fields += [T.StructField(x, T.ArrayType(T.LongType())) for x in ("least", "keys")]
    return map_columns(df, make, [text], fields, drop=[text])


def forest(count: int, near) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all that near(i, others), a mask, joins. What is joined already isn't compared again."""
    left = np.arange(count)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            good = near(i, left)
            if good.any():
                new, left = left[good], left[~good]
                a.append(np.full(len(new), i))
                b.append(new)
                todo.extend(new)
    return np.concatenate(a), np.concatenate(b)


def candidate_links(batches):
    """Links that join all pairs of a group that aren't joined yet, of unlike comp, and that sizes, pivot tables and distances don't rule out.

    The rows come sorted by (key, lo, hi).
    """

    def links(rows: dict[str, np.ndarray]):
        node, n, comp = rows["node"], rows["n"], rows["comp"]
        distance = Fingerprints(rows["cells"].tolist()).distances

        def maybe(i, j, tables=None):
            """Whether pairs may be similar. Distances are at most the shingles that aren't shared, and so are differences of distances to one pivot."""
            good = np.flatnonzero(similar(np.minimum(n[i], n[j]), n[i], n[j]) & (comp[i] != comp[j]))
            a, b = i[good], j[good]
            if tables is not None:
                apart = np.abs(tables(a) - tables(b)).max(axis=1)
                near = similar((n[a] + n[b] - apart) // 2, n[a], n[b])
                good, a, b = good[near], a[near], b[near]
            out = np.zeros(len(i), bool)
            out[good] = similar((n[a] + n[b] - distance(a, b)) // 2, n[a], n[b])
            return out

        change = np.ones(len(node), bool)
        change[1:] = False
        for c in ("key", "lo", "hi"):
            change[1:] |= rows[c][1:] != rows[c][:-1]
        starts = np.flatnonzero(change)
        sizes = np.diff(np.append(starts, len(node)))
        group, small = np.repeat(np.arange(len(starts)), sizes), np.repeat(sizes < SMALL, sizes)
        out = [(np.empty(0, np.int64),) * 2]
        for step in range(1, min(SMALL, len(node))):
            i = np.flatnonzero((group[step:] == group[:-step]) & small[step:])
            i = i[maybe(i, i + step)]
            out.append((node[i], node[i + step]))
        for s, size in zip(starts[sizes >= SMALL], sizes[sizes >= SMALL]):
            pivots = s + np.unique(np.linspace(0, size - 1, PIVOTS).astype(np.int64))
            own = np.arange(s, s + size)
            table = np.stack([distance(own, np.full(size, p)) for p in pivots], axis=1)
            i, j = forest(size, lambda i, j, s=s, table=table: maybe(np.full(len(j), s + i), s + j, lambda x: table[x - s]))
            out.append((node[s + i], node[s + j]))
        pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*out)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in pairs], names=["a", "b"])

    carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(batch.schema.names)}
        if carry is not None:
            rows = {c: np.concatenate([carry[c], x]) for c, x in rows.items()}
        whole = np.ones(len(rows["node"]), bool)
        for c in ("key", "lo", "hi"):
            whole &= rows[c] == rows[c][-1]
        cut = len(whole) - int(whole.sum())
        carry = {c: x[cut:] for c, x in rows.items()}
        if cut:
            yield links({c: x[:cut] for c, x in rows.items()})
    if carry is not None:
        yield links(carry)


def true_links(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all similar ones of some sets, by the sets themselves."""
    n = np.array([len(x) for x in sets])
    ends = np.cumsum(n)
    universe, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(universe), bool)

    def near(i, others):
        good = similar(np.minimum(n[i], n[others]), n[i], n[others])
        some = others[good]
        own = flat[ends[i] - n[i] : ends[i]]
        mark[own] = True
        shared = np.array([np.count_nonzero(mark[flat[ends[j] - n[j] : ends[j]]]) for j in some], np.int64)
        mark[own] = False
        good[good] = similar(shared, n[i], n[some])
        return good

    return forest(len(sets), near)


def cluster_links(batches):
    """True links of the texts of each cluster; rows come sorted by (key, lo, hi)."""

    def links(nodes: list[int], sets: list[np.ndarray]):
        a, b = true_links(sets)
        names = np.array(nodes, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[b])], names=["a", "b"])

    last, nodes, sets = None, [], []
    for batch in batches:
        marks = zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in ("key", "lo", "hi")))
        node = batch.column(batch.schema.names.index("node")).to_pylist()
        for mark, name, text in zip(marks, node, as_bytes(batch.column(batch.schema.names.index("text")))):
            if mark != last and nodes:
                yield links(nodes, sets)
                nodes, sets = [], []
            last = mark
            nodes.append(name)
            sets.append(shingles(text))
    if nodes:
        yield links(nodes, sets)


def similar_groups(df: DataFrame, row: str, text: str = "text", tile: int = TILE, cluster_tile: int = CLUSTER_TILE) -> DataFrame:
    """row, group (long) of a table of rows' texts: rows that are linked, directly or not, share it; a link is a similarity of 0.8.

    Texts of equal sets are made one first; null, empty and blank ones have the empty set, which is like itself only.
    Every row is in one group; an empty table has none. `row` must be distinct and read the same each time.
    """
    df = df.select(row, text)
    prints = checkpoint(signatures(df, common_shingles(df, text), text))
    firsts = checkpoint(prints.groupBy("sig0", "sig1").agg(F.min(row).alias("node"), F.count("*").alias("_rows")))
    own = prints.join(firsts.select("node"), F.col(row) == F.col("node"))
    sketches, texts = prints.select(F.col(row).alias("node"), "cells"), df.select(F.col(row).alias("node"), F.col(text).alias("text"))
    sizes = (tile, cluster_tile)
    first = simhash_clusters(own.select("node", "n", "fp", F.col("least").alias("keys")))
    near = first.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b"))
    links = true_pairs(first, sketches, texts, *sizes, more=near)
    roots = connected_components(links)
    own = checkpoint(own.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("comp"), "n", "keys"))
    links = links.union(true_pairs(own, sketches, texts, *sizes))
    roots = connected_components(links).withColumnsRenamed({"node": "_node", "root": "_root"})
    joined = firsts.join(roots, F.col("node") == F.col("_node"), "left")
    joined = checkpoint(joined.select("sig0", "sig1", "_rows", F.coalesce("_root", "node").alias("group")))
    return join_counted(prints.select(row, "sig0", "sig1"), joined, ["sig0", "sig1"], "_rows").select(row, "group")


def simhash_clusters(own: DataFrame) -> DataFrame:
    """`own`, of node and fp, without fp and with comp: the least node of those that links of near SimHash fingerprints join, directly or not."""
    own = checkpoint(own)
    roots = connected_components(near_links(own.select("fp").distinct())).withColumnRenamed("node", "fp")
    joined = checkpoint(own.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")).drop("fp"))
    least = joined.groupBy("root").agg(F.min("node").alias("comp"), F.count("*").alias("_n"))
    return checkpoint(join_counted(joined, least, ["root"], "_n", total=joined.count()).drop("root"))


def true_pairs(own: DataFrame, sketches: DataFrame, texts: DataFrame, tile: int, cluster_tile: int, more: DataFrame | None = None) -> DataFrame:
    """a, b (long): links of similar nodes that join all similar ones, not joined yet, that share one of their keys. `own` has node, comp, n and keys.

    `more` are links to verify too, which join the nodes of each comp.
    """
    members = groups(own.select("node", "comp", F.explode("keys").alias("key")))
    keyed = checkpoint(members.join(own.drop("keys"), "node").join(sketches, "node"))
    maybe = deal(keyed, tile, "node", "comp", "n", "cells").mapInArrow(letting_go(candidate_links), LINKS)
    maybe = connected_components(maybe if more is None else maybe.union(more))
    members = maybe.join(own.select("node", "n"), "node").select(F.col("root").alias("key"), "node", "n")
    return verified(checkpoint(members), texts, cluster_tile)


def wanted(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of `texts` of a node in `nodes`, and a few others: by a bit map of fixed size, so that the rest isn't shuffled."""
    bit = F.pmod(F.xxhash64("node"), F.lit(MAP))
    spot = lambda df: df.withColumns({"_row": F.floor(bit / MAP_ROW).cast("int"), "_bit": F.pmod(bit, F.lit(MAP_ROW))})
    rows = spot(nodes.select("node")).groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    byte = F.conv(F.hex(F.expr("substring(_map, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    found = spot(texts).join(F.broadcast(rows), "_row").where(byte.bitwiseAND(F.expr("shiftleft(1, cast(_bit % 8 as int))")) != 0)
    return found.select(*texts.columns)


def groups(keyed: DataFrame) -> DataFrame:
    """node, key (long) of the groups in node, comp, key of two comps and more; of groups of equal members only one.

    Its new key is a hash of the members' number and of the sum of their hashes. Should two groups fall together, they are compared as one.
    """
    members = keyed.groupBy("key").agg(
        F.count("*").alias("_n"), F.sum(F.shiftright(F.xxhash64("node"), 20)).alias("_sum"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi")
    )
    members = checkpoint(members.where("_lo < _hi").select("key", "_n", F.xxhash64("_n", "_sum").alias("_group")))
    return join_counted(keyed, members, ["key"], "_n").select("node", F.col("_group").alias("key")).distinct()


def verified(members: DataFrame, texts: DataFrame, tile: int) -> DataFrame:
    """a, b (long): links that join what the true links within each cluster (key, node, and n, its shingles) join.

    A text is large and a cluster may hold a third of all, so texts aren't sent to every pair of a cluster's parts. First each part
    is compared in itself, which sends each text once. Then one text of each component found is compared with the others', which
    joins what is one group of near copies. Only clusters that are more than one component still are compared in full: the largest
    component's parts, already joined in themselves, with parts of the rest, and the rest with each other.
    """
    limit = {"weight": "n", "most": CLUSTER_SHINGLES}

    def compare(dealt: DataFrame) -> DataFrame:
        sent = dealt.select("key", "lo", "hi", "node").join(wanted(texts, dealt), "node")
        return checkpoint(gather(sent).mapInArrow(letting_go(cluster_links), LINKS))

    parted = checkpoint(parts(members, tile, "node", **limit))
    links = compare(parted.select("key", F.col("part").alias("lo"), F.col("part").alias("hi"), "node"))
    roots = connected_components(links)
    many = parted.where("parts > 1").select("key", "node", "n")
    many = checkpoint(many.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("comp")))
    if many.isEmpty():
        return links
    firsts = many.groupBy("key", F.col("comp").alias("node")).agg(F.count("*").alias("_n"), F.sum("n").alias("sum"), F.max("n").alias("n"))
    firsts = checkpoint(firsts)
    joining = compare(tiles(firsts.select("key", "node", "n"), tile, "node", **limit))
    joined = connected_components(joining)
    sizes = firsts.join(joined, "node", "left").groupBy("key", F.coalesce("root", "node").alias("comp"))
    sizes = sizes.agg(F.sum("_n").alias("_n"), F.sum("sum").alias("sum"))
    apart = sizes.groupBy("key").agg(
        F.max(F.struct("_n", "comp", "sum")).alias("big"), F.sum("_n").alias("_n"), F.sum("sum").alias("sum")
    )
    parts_of = lambda n, m: F.greatest(F.ceil(n / tile), F.ceil(m / CLUSTER_SHINGLES)).cast("int")
    apart = apart.where("big._n < _n").select(
        "key", "_n", F.col("big.comp").alias("big"), parts_of(F.col("big._n"), F.col("big.sum")).alias("bigs"),
        parts_of(F.col("_n") - F.col("big._n"), F.col("sum") - F.col("big.sum")).alias("rests"),
    )
    apart = checkpoint(apart)
    links = links.union(joining)
    if not apart.isEmpty():
        rows = many.join(joined.select(F.col("node").alias("comp"), "root"), "comp", "left")
        rows = rows.select("key", "node", F.coalesce("root", "comp").alias("comp"))
        rows = join_counted(checkpoint(rows), apart, ["key"], "_n")
        large = F.col("comp") == F.col("big")
        rows = rows.withColumn("part", F.pmod(F.xxhash64("node", F.lit(2)), F.when(large, F.col("bigs")).otherwise(F.col("rests"))).cast("int"))
        pair = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
        part, bigs, rests = F.col("part"), F.col("bigs"), F.col("rests")
        with_big = F.transform(F.sequence(F.lit(0), bigs - 1), lambda i: pair(part, rests + i))
        with_rest = F.transform(F.sequence(F.lit(0), rests - 1), lambda j: pair(F.least(part, j), F.greatest(part, j)))
        with_rest = F.filter(with_rest, lambda x: x["lo"] < x["hi"])
        own = F.transform(F.sequence(F.lit(0), rests - 1), lambda j: pair(j, rests + part))
        rows = rows.select("key", "node", F.explode(F.when(large, own).otherwise(F.concat(with_big, with_rest))).alias("at"))
        links = links.union(compare(rows.select("key", "at.lo", "at.hi", "node")))
    return links

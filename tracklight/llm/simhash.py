"""Near-duplicates by SimHash fingerprints, found with pivot distance tables.

A pair of fingerprints can only be near if its distances to any reference fingerprint are near too.
Within a group of candidates, the Hamming distances to many references are a table; the maximum
difference of two rows of it discards most pairs, and the survivors' own distance is taken.

A pivot table alone would have to look at all pairs. Its groups therefore come from the pigeonhole
principle: of `radius` + 2 blocks of bits, two near fingerprints agree in two at least, so each
fingerprint stands in one group for each pair of blocks, and no link is lost. Fingerprints are made
distinct first, so exact copies cost nothing here. A group of over TILE fingerprints is dealt as
tiles of pairs of parts to as many tasks as it needs. Each tile gives the links that join its
components only, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklight.llm.common import as_bytes, checkpoint, join_counted, letting_go, long, map_columns
from tracklight.llm.components import connected_components, stars

#: Words in a shingle, and bits in which linked fingerprints may differ.
WORDS, RADIUS = 4, 4
#: Reference fingerprints.
PIVOTS = np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, 42) for i in range(8)], dtype=np.uint64)
#: Fingerprints of a group that one task compares with each other.
TILE = 2048
#: Smaller groups are compared many at a time.
SMALL = 8


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """The SimHash of a text's UTF-8: a bit is 1 if it is set in over half the shingles' XXH64 of seed 42."""
    parts = text.lower().split() if text else []
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), 42)
    digest = xxhash.xxh64_intdigest
    shingles = zip(*(parts[i:] for i in range(words)), strict=False)
    hashes = np.fromiter((digest(b" ".join(s), 42) for s in shingles), np.uint64, len(parts) - words + 1)
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 8192):
        block = np.ascontiguousarray(hashes[start : start + 8192]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, text: str = "text", words: int = WORDS, drop_text: bool = False) -> DataFrame:
    """`df` with fp (long): the 64 bits of the whole text's SimHash. A null text has that of an empty one, zero."""

    def make():
        return lambda column: [np.array([fingerprint(x, words) for x in as_bytes(column)], np.uint64).view(np.int64)]

    return map_columns(df, make, [text], [long("fp")], drop=[text] if drop_text else [])


def keys(radius: int) -> F.Column:
    """An array with a key for each pair of blocks: the pair's number above the two blocks' bits."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:])]
    width = max(hi - lo for lo, hi in zip(edges, edges[1:]))
    return F.array(
        *(
            F.lit(k << (2 * width)).bitwiseOR(F.shiftleft(blocks[i], width)).bitwiseOR(blocks[j])
            for k, (i, j) in enumerate(combinations(range(n), 2))
        )
    )


def near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """The matrix of links: pivot tables discard, the distance itself decides on what is left."""
    table_a, table_b = (np.bitwise_count(x[None, :] ^ PIVOTS[:, None]).astype(np.int8) for x in (a, b))
    out = np.zeros((len(a), len(b)), bool)
    for start in range(0, len(a), 256):
        rows = slice(start, start + 256)
        maybe = np.abs(table_a[0, rows, None] - table_b[0, None, :]) <= radius
        for k in range(1, len(PIVOTS)):
            maybe &= np.abs(table_a[k, rows, None] - table_b[k, None, :]) <= radius
        i, j = np.nonzero(maybe)
        good = np.bitwise_count(a[rows][i] ^ b[j]) <= radius
        out[i[good] + start, j[good]] = True
    return out


def link_groups(batches, radius: int):
    """Links within groups. The rows come sorted by group: (key, lo, hi), with fp and the side of each row."""
    carry = None

    def links(rows: dict[str, np.ndarray]):
        """Of whole groups."""
        fp, side = rows["fp"], rows["side"]
        change = np.zeros(len(fp), bool)
        change[0] = True
        for c in ("key", "lo", "hi"):
            change[1:] |= rows[c][1:] != rows[c][:-1]
        starts = np.flatnonzero(change)
        sizes = np.diff(np.append(starts, len(fp)))
        bits = fp.view(np.uint64)
        small = np.repeat(sizes < SMALL, sizes)
        group = np.repeat(np.arange(len(starts)), sizes)
        tile = rows["lo"] != rows["hi"]
        out = [(np.empty(0, np.int64),) * 2]
        for step in range(1, min(SMALL, len(fp))):
            i = np.flatnonzero((group[step:] == group[:-step]) & small[step:])
            i = i[~tile[i] | (side[i] != side[i + step])]
            if len(i):
                tables = [np.bitwise_count(bits[x][None, :] ^ PIVOTS[:, None]).astype(np.int8) for x in (i, i + step)]
                i = i[np.abs(tables[0] - tables[1]).max(axis=0) <= radius]
                i = i[np.bitwise_count(bits[i] ^ bits[i + step]) <= radius]
                out.append((fp[i], fp[i + step]))
        for s, n in zip(starts[sizes >= SMALL], sizes[sizes >= SMALL]):
            own = bits[s : s + n]
            one, two = (own[side[s : s + n] == x] for x in (0, 1)) if tile[s] else (own, own)
            out.append(stars(near(one, two, radius), one.view(np.int64), two.view(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["a", "b"])

    for batch in batches:
        rows = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(batch.schema.names)}
        if not batch.num_rows:
            continue
        if carry is not None:
            rows = {c: np.concatenate([carry[c], x]) for c, x in rows.items()}
        last = {c: rows[c][-1] for c in ("key", "lo", "hi")}
        whole = np.ones(len(rows["fp"]), bool)
        for c, x in last.items():
            whole &= rows[c] == x
        cut = len(whole) - int(whole.sum())
        carry = {c: x[cut:] for c, x in rows.items()}
        if cut:
            yield links({c: x[:cut] for c, x in rows.items()})
    if carry is not None:
        yield links(carry)


def parts(keyed: DataFrame, tile: int, column: str, weight: str | None = None, most: int = 1) -> DataFrame:
    """Rows of a table with column key, with the row's part and parts, the number of parts that its group is cut into.

    A part has about `tile` rows at most and, if there is a column `weight`, about `most` of it. A row that is alone in its group
    has nothing to be compared with and is left out; of blocks' groups these are most.
    """
    n = F.ceil(F.count("*") / tile)
    n = F.greatest(n, F.ceil(F.sum(weight) / most)) if weight else n
    counts = keyed.groupBy("key").agg(F.count("*").alias("_n"), n.cast("int").alias("parts")).where("_n > 1")
    part = F.pmod(F.xxhash64(column, F.lit(1)), F.col("parts")).cast("int")
    return join_counted(keyed, counts, ["key"], "_n", total=keyed.count()).withColumn("part", part)


def tiles(keyed: DataFrame, tile: int, *columns: str, weight: str | None = None, most: int = 1) -> DataFrame:
    """Rows of (key, columns) as groups (key, lo, hi), with the side of each row.

    A group that is cut into parts() by a hash of the first column has each pair of parts as a group of its own.
    """
    dealt = parts(keyed, tile, columns[0], weight, most).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select(
        "key",
        F.least("part", "other").alias("lo"),
        F.greatest("part", "other").alias("hi"),
        (F.col("part") > F.col("other")).cast("int").alias("side"),
        *columns,
    )


def gather(dealt: DataFrame) -> DataFrame:
    """The rows of each group (key, lo, hi) in one task, one group after another."""
    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")


def deal(keyed: DataFrame, tile: int, *columns: str) -> DataFrame:
    """Rows of (key, columns) dealt to tasks as tiles()."""
    return gather(tiles(keyed, tile, *columns))


LINKS = T.StructType([long("a"), long("b")])


def near_links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """a, b (long): links between distinct fingerprints in column fp that join all that differ in up to `radius` bits.

    All components of the near fingerprints are joined; not every near pair is listed.
    """
    keyed = prints.select("fp", F.explode(keys(radius)).alias("key"))
    return deal(keyed, tile, "fp").mapInArrow(letting_go(lambda batches: link_groups(batches, radius)), LINKS)


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", fp: str = "fp", radius: int = RADIUS) -> DataFrame:
    """`df`, which has fingerprints in column `fp`, with component_id (long).

    Documents whose fingerprints differ in up to `radius` bits are linked; component_id is the
    smallest non-null id that can be reached over links, a document's own included, and null only if
    all ids of the component are null. Repeated rows and equal ids each keep their row. Other columns stay,
    but for a column named component_id, which is replaced. A fingerprint is never null if it comes
    from fingerprints(); a null one is linked with nothing and has its own id.
    """
    df = df.drop("component_id")
    least = [F.min(doc_id).alias("least_id"), F.count("*").alias("_rows")]
    prints = checkpoint(df.where(F.col(fp).isNotNull()).groupBy(F.col(fp).alias("fp")).agg(*least))
    roots = connected_components(near_links(prints.select("fp"), radius))
    joined = prints.join(roots, prints["fp"] == roots["node"], "left")
    joined = checkpoint(joined.select("fp", "least_id", "_rows", F.coalesce("root", "fp").alias("root")))
    linked = joined.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("_n"))
    lookup = checkpoint(join_counted(joined, linked, ["root"], "_n").select(F.col("fp").alias("_fp"), "component_id", "_rows"))
    out = join_counted(df.withColumn("_fp", F.col(fp)), lookup, ["_fp"], "_rows", "left").drop("_fp").select(*df.columns, "component_id")
    return out.withColumn("component_id", F.when(F.col(fp).isNull(), F.col(doc_id)).otherwise(F.col("component_id")))


def fingerprint_hex(fp: str = "fp") -> F.Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

"""Merkle manifest of a dataset: a tree over each source's records, and one over the sources.

A node is the SHA-256 of what is under it; every ARITY consecutive nodes have one parent. Leaves are numbered by range
partitions, and cut into blocks aligned to ARITY**HEIGHT, so that a block is a whole subtree. A block is an Arrow table in
one task, in which DuckDB asks for one level after the other: string_agg in order, then sha256. The blocks' roots are the
next tier's leaves, so a hundred billion leaves take three tiers; Spark gathers them into blocks again. On the way
down, every block meets its own outer proof, one row, and each leaf's siblings are completed by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazaflow.llm.common import cut, numbered

ARITY = 3
#: Levels within a block: of 2,187 leaves, some 2 MB with their proofs.
HEIGHT = 7
BLOCK = ARITY**HEIGHT
#: Hexadecimal digits of a node.
WIDTH = 64


def encoded(value: Column) -> Column:
    """A value as a leaf hashes it: its UTF-8 bytes after their number, or a dash for null."""
    return F.coalesce(F.concat(F.octet_length(value.cast("string")).cast("string"), F.lit(":"), value.cast("string")), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, columns)), 256)


def tree_key(source: Column) -> Column:
    """The source as a text that is never null and sorts null first, others by their bytes."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


@lru_cache(1)
def _engine() -> duckdb.DuckDBPyConnection:
    """The worker's own engine, in memory, with one thread as Spark counts on."""
    con = duckdb.connect(":memory:")
    con.execute("SET threads = 1")
    return con


@contextmanager
def _levels(block: pa.Table, height: int) -> Iterator[duckdb.DuckDBPyConnection]:
    """A connection with the table block, and run0, run1, ...: of each parent at a level its children's hashes, in order, as
    one text. All of it goes with the connection."""
    con = _engine().cursor()
    con.register("block", block)
    below = "SELECT i, hash FROM block"
    for k in range(height):
        con.execute(f"CREATE OR REPLACE TEMP TABLE run{k} AS SELECT i // {ARITY} AS p, string_agg(hash, '' ORDER BY i) AS run FROM ({below}) GROUP BY ALL")
        below = f"SELECT p AS i, sha256(run) AS hash FROM run{k}"
    try:
        yield con
    finally:
        con.close()


def _height(n: int) -> int:
    """Levels above n nodes until one is left."""
    found, reach = 0, 1
    while reach < n:
        found, reach = found + 1, reach * ARITY
    return found


def _blocks(nodes: DataFrame):
    return nodes.groupBy("tree", F.floor(F.col("i") / BLOCK).alias("b"))


def roots(nodes: DataFrame) -> DataFrame:
    """(tree, i, n, hash) of the roots of all blocks of nodes (the same columns): i is the place in the tree, from 0, of n."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        n = table["n"][0].as_py()
        height = min(_height(n), HEIGHT)
        with _levels(table, height) as con:
            root = con.sql(f"SELECT sha256(run) FROM run{height - 1}" if height else "SELECT hash FROM block").fetchall()[0][0]
        return pa.table({"tree": pa.array([key[0].as_py()], pa.string()), "i": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([-(-n // BLOCK)], pa.int64()), "hash": pa.array([root], pa.string())})

    return _blocks(nodes.select("tree", "i", "n", "hash")).applyInArrow(run, "tree string, i bigint, n bigint, hash string")


def climbed(nodes: DataFrame) -> list[DataFrame]:
    """The nodes, the roots of their blocks, those of the blocks of these, and so on to one node a tree; all written."""
    tiers = [nodes]
    while True:
        tiers.append(cut(roots(tiers[-1])))
        if (tiers[-1].agg(F.max("n")).first()[0] or 1) == 1:
            return tiers


def _sides(height: int) -> str:
    """l0, r0, l1, ...: what stands left and right of a block's node, or of what is above it, at each level."""
    own = [f"{WIDTH} * CAST(i // {ARITY**k} % {ARITY} AS INT)" for k in range(height)]
    return "".join(f", substr(run{k}.run, 1, {own[k]}) AS l{k}, substr(run{k}.run, {own[k]} + {WIDTH + 1}) AS r{k}" for k in range(height))


def _joins(height: int) -> str:
    return "".join(f" JOIN run{k} ON run{k}.p = i // {ARITY ** (k + 1)}" for k in range(height))


OUTER = "tree string, b bigint, subroot string, root string, lefts array<string>, rights array<string>"


def inner(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """The path of every node as the outer proof of the block that it is the root of (OUTER), from those of its own tier's blocks."""

    def run(key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
        top = above.to_pylist()[0]
        height = min(_height(table["n"][0].as_py()), HEIGHT)
        with _levels(table, height) as con:
            sides = con.sql(f"SELECT i{_sides(height)} FROM block{_joins(height)}").fetchall()
        rows = [{"tree": top["tree"], "b": i, "subroot": top["subroot"], "root": top["root"], "lefts": [*s[0::2], *top["lefts"]], "rights": [*s[1::2], *top["rights"]]} for i, *s in sides]
        return pa.Table.from_pylist(rows, above.schema)

    return _blocks(nodes).cogroup(outer.groupBy("tree", "b")).applyInArrow(run, OUTER)


def descended(tiers: list[DataFrame], top: DataFrame) -> DataFrame:
    """The outer proofs of the blocks of the lowest tier, from those of whole trees (`top`, one row a tree)."""
    outer = top
    for tier in tiers[-2:0:-1]:
        outer = inner(tier, outer)
    return outer


def proofs(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf, from nodes with doc_id and `tampered`,
    the leaf as it is found (null: untouched)."""

    def run(key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
        top = above.to_pylist()[0]
        height = min(_height(table["n"][0].as_py()), HEIGHT)
        steps = [(f"l{k}", f"r{k}") for k in range(height)] + [("$" + f"l{k}", "$" + f"r{k}") for k in range(len(top["lefts"]))]
        values = {f"l{k}": v for k, v in enumerate(top["lefts"])} | {f"r{k}": v for k, v in enumerate(top["rights"])}
        folded = "coalesce(tampered, hash)"
        query = f"SELECT doc_id, hash, {folded} AS f{_sides(height)} FROM block{_joins(height)}"
        for left, right in steps:
            query = f"SELECT * REPLACE (sha256({left} || f || {right}) AS f) FROM ({query})"
        proof = " || ".join(["''", *(side for step in steps for side in step)])
        query = f"SELECT doc_id, hash AS leaf, $subroot AS subroot, $root AS root, sha256({proof}) AS proof_sha256, f AS folded_root, f = $root AS verified FROM ({query})"
        with _levels(table, height) as con:
            return con.sql(query, params=values | {"subroot": top["subroot"], "root": top["root"]}).to_arrow_table()

    return _blocks(nodes).cogroup(outer.groupBy("tree", "b")).applyInArrow(run, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(leaves: DataFrame) -> DataFrame:
    """proofs() of leaves: doc_id, tree (a text that is never null, trees in its order), hash, and tampered. Leaves of a tree ascend
    by id, a null one first, those of one id by hash."""
    placed = cut(numbered(cut(leaves), [F.col("doc_id").asc_nulls_first(), F.col("hash")], "i", "tree", "n"))
    tiers = climbed(placed)
    whole = lambda df, root: df.select("tree", F.lit(0).cast("long").alias("b"), F.col("hash").alias("subroot"), root.alias("root"), F.array().cast("array<string>").alias("lefts"), F.array().cast("array<string>").alias("rights"))
    sources = cut(numbered(tiers[-1].select(F.col("tree").alias("source"), "hash"), [F.col("source")], "i", None, "n").withColumn("tree", F.lit("")))
    upper = climbed(sources.select("tree", "i", "n", "hash"))
    path = inner(upper[0], descended(upper, whole(upper[-1], F.col("hash"))))
    top = sources.join(path.select("b", "root", "lefts", "rights"), F.col("i") == F.col("b")).select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("b"), F.col("hash").alias("subroot"), "root", "lefts", "rights")
    return proofs(placed, descended(tiers, top))


def report(docs: DataFrame) -> DataFrame:
    """proofs() of documents, where text was tampered with in rows whose id has an even checksum: its line ends are gone.

    Null values have their own mark, so none equals an empty text; rows of a null source are a tree of their own, rows of a null id
    are not tampered with, repeated rows are leaves of their own; other columns are ignored. An empty table gives no rows.
    """
    held = ("doc_id", "source", "lang", "n_chars")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, leaf([*map(F.col, held), F.replace("text", F.lit("\n"), F.lit(""))]))
    return manifest(docs.select("doc_id", tree_key(F.col("source")).alias("tree"), leaf([*map(F.col, held), F.col("text")]).alias("hash"), tampered.alias("tampered")))

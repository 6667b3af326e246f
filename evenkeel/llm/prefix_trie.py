"""The prefix trie of conversations rebuilt from a shared head and an own rest, by composed fingerprints."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evenkeel.llm.common import query, sha, table
from evenkeel.llm.monoid import PRIME, running_products
from evenkeel.session import cut_lineage

LANES = 4                                    # residues of 31 bits a fingerprint
PACK = 1 << 16                               # characters of ids hashed at once
NODE = ["depth", "k1", "k2"]
WORD = r"[^\x20\x09-\x0D]+"
E = [f"e{k}" for k in range(LANES)]


def lane_bases(seed: int) -> list[int]:
    draw = random.Random(f"lanes {seed}")
    return [draw.randrange(1 << 20, PRIME - 1) for _ in range(LANES)]


def _packed(lanes: list[Column], names: tuple[str, str]) -> list[Column]:
    """Two longs from four residues of 31 bits."""
    return [(F.shiftleft(lanes[0], 31) + lanes[1]).alias(names[0]), (F.shiftleft(lanes[2], 31) + lanes[3]).alias(names[1])]


def _table_of(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (at + 1).cast("int"))


def _rebuilt(turns: DataFrame, seed: int, every: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """(conversations with their rebuilt length, turns of the rebuilt conversations with node and parent keys)."""
    bases = lane_bases(seed)
    own = turns.select("conv", "at", "role", "text", F.xxhash64(F.lit(seed), "role", "text").alias("h1"),
                       F.xxhash64(F.lit(seed + 1), "role", "text").alias("h2"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    own = own.select("*", *[F.pmod(F.xxhash64(F.lit(k), "h1", "h2"), F.lit(PRIME)).alias(e) for k, e in enumerate(E)])
    # the texts only order turns of one number; after the sort they are left behind
    scanned = running_products(own, "conv", ["at", "role", "text"], E, bases, leave=["at", "role", "text", *E])
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    scanned = scanned.withColumn("taken", taken)

    turn = F.struct("pos", "h1", "h2", "words", *[f"{e}_{w}" for e in E for w in ("upto", "before")])
    head = (scanned.where((F.col("conv") % every == 0) & (F.col("pos") < heads))          # fewer than `heads` turns each
            .groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(turn)).alias("head")))
    convs = scanned.groupBy("conv", "taken").agg(
        F.max("pos").alias("n_own"), *[F.max(F.when(F.col("pos") == F.col("taken"), F.col(f"{e}_upto"))).alias(f"{e}_own") for e in E])
    used = F.filter(F.coalesce("head", F.array().cast(head.schema["head"].dataType)), lambda t: t["pos"] <= F.col("taken"))
    convs = convs.withColumn("base", F.col("conv") - F.col("conv") % every).join(head, "base", "left").withColumn("used", used)
    convs = convs.withColumn("n_head", F.size("used"))
    last = [F.coalesce(F.when(F.col("n_head") > 0, F.element_at(F.col("used"), -1)[f"{e}_upto"]), F.lit(0).cast("long")).alias(f"{e}_head") for e in E]
    rest = F.greatest(F.col("n_own") - F.col("taken"), F.lit(0))
    # a plain table on this side lets the planner split a long conversation's turns
    convs = cut_lineage(convs.select("conv", "used", "n_head", (F.col("n_head") + rest).alias("len"), *last, *[f"{e}_own" for e in E]))

    common = convs.select("conv", "len", F.explode("used").alias("t"))
    common = common.select("conv", "len", F.col("t.pos").alias("depth"), "t.h1", "t.h2", "t.words",
                           *_packed([F.col(f"t.{e}_upto") for e in E], ("k1", "k2")), *_packed([F.col(f"t.{e}_before") for e in E], ("q1", "q2")))
    met = scanned.where(F.col("pos") > F.col("taken")).join(convs.drop("used"), "conv")

    def composed(what: str) -> list[Column]:
        """The head's product, then that of the own turns behind those taken off: nothing but residues is touched."""
        out = []
        for e, b in zip(E, bases):
            cut = F.pmod(F.col(f"{e}_{what}") - F.coalesce(F.col(f"{e}_own"), F.lit(0)), F.lit(PRIME))
            suffix = cut * _table_of([pow(b, -n, PRIME) for n in range(heads)], F.col("taken")) % PRIME
            out.append((F.col(f"{e}_head") + _table_of([pow(b, n, PRIME) for n in range(heads)], F.col("n_head")) * suffix) % PRIME)
        return out

    own_part = met.select("conv", "len", (F.col("n_head") + F.col("pos") - F.col("taken")).alias("depth"), "h1", "h2", "words",
                          *_packed(composed("upto"), ("k1", "k2")), *_packed(composed("before"), ("q1", "q2")))
    return convs.select("conv", "len"), cut_lineage(common.unionByName(own_part))


def _one_text_per_hash(turns: DataFrame, seed: int) -> bool:
    """Whether all stored turns of one hash are the same turn, by their roles and texts."""
    found = (turns.groupBy(F.xxhash64(F.lit(seed), "role", "text"), F.xxhash64(F.lit(seed + 1), "role", "text"))
             .agg(F.min("role").alias("a"), F.max("role").alias("b"), F.min("text").alias("c"), F.max("text").alias("d")))
    return found.where("a <> b OR c <> d").isEmpty()


def _ends_digest(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the sorted ids that end in each node.

    Ids are dealt into ranges of (node, id) and packed into texts there; what a node's task reads are few packed
    rows in order, hashed one after another, so a node in which a third of all conversations end is no large group.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "depth long, k1 long, k2 long, first long, ids string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, now, size = [], None, 0
            for *node, conv in zip(*[c.to_pylist() for c in batch.columns]):
                if node != now or size > PACK:
                    rows.append([*node, conv, [str(conv)]])
                    now, size = node, 0
                else:
                    rows[-1][4].append(str(conv))
                size += 12
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, [*r[:4], ",".join(r[4])])) for r in rows], schema=arrow)

    out_schema = "depth long, k1 long, k2 long, ends_sha256 string"
    out_arrow = to_arrow_schema(StructType.fromDDL(out_schema))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            rows = []
            for *node, _, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if node == now:
                    state.update(b"," + ids.encode())
                    continue
                if now is not None:
                    rows.append([*now, state.hexdigest()])
                now, state = node, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(out_arrow.names, r)) for r in rows], schema=out_arrow)
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(out_arrow.names, [*now, state.hexdigest()]))], schema=out_arrow)

    ranged = ends.select(*NODE, "conv").repartitionByRange(parts, *NODE, "conv").sortWithinPartitions(*NODE, "conv")
    packed = ranged.mapInArrow(pack, schema).repartition(parts, *NODE).sortWithinPartitions(*NODE, "first")
    return packed.mapInArrow(digest, out_schema)


def prefix_trie(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                every: int = 20, heads: int = 4, seed: int = 1) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    Conversation c is the first crc32(decimal c) % heads turns of conversation c - c % every, then its own turns behind
    as many. Turns go by number, NULL first, then role and text; a NULL role or text is empty; equal rows are turns of
    their own; rows without conv_id are left out; other columns are not looked at; an empty table has no nodes. A
    node's key is (depth, fingerprint); the root's is (0, 0). Columns: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Every turn is an element of a hash monoid. Prefix products of the stored turns are made once, by ranges of rows;
    a rebuilt prefix is the product of a head's prefix and of an own rest, whose value follows from two prefixes of the
    conversation, so no rebuilt text is ever put together. Groups of equal fingerprints are then verified: all turns of
    one hash hold one role and text, and in every group all last turns have one hash and all parents one
    fingerprint; by induction over the depth, equal fingerprints are equal sequences. Should one group fail, all is done again
    with another seed. Subtree sums are sums over members: a node's weight is given to its smallest member, and
    summed from the deepest node up along each conversation.
    """
    t = turns.select(F.col(f"`{conv_id}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("at"),
                     F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    t = t.where("conv IS NOT NULL")
    while True:
        convs, rows = _rebuilt(t, seed, every, heads)
        nodes = cut_lineage(rows.groupBy(*NODE).agg(
            F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.count_if(F.col("depth") == F.col("len")).alias("n_ends"),
            F.max("words").alias("words"), F.min("q1").alias("q1"), F.min("q2").alias("q2"),
            ((F.min("h1") == F.max("h1")) & (F.min("h2") == F.max("h2")) & (F.min("q1") == F.max("q1")) & (F.min("q2") == F.max("q2"))).alias("sure")))
        if _one_text_per_hash(t, seed) and nodes.where("NOT sure").isEmpty():
            break
        seed += 2

    # only nodes of several conversations need sums; a node of one has one leaf and saves nothing
    shared = nodes.where("n_convs > 1")
    kids = (nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2"))
            .agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("n_single")))
    shared = cut_lineage(shared.join(kids, NODE, "left").select(
        *NODE, "q1", "q2", "n_convs", "conv_id", "n_ends", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        (F.coalesce("n_single", F.lit(0)) + (F.col("n_ends") == F.col("n_convs")).cast("long")).alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved")))
    first = F.col("conv") == F.col("conv_id")
    along = rows.select("conv", *NODE).join(shared.select(*NODE, "conv_id", "leaves", "saved"), NODE).select(
        "conv", *NODE, (-F.col("depth")).alias("up"), *[F.when(first, F.col(c)).otherwise(0).alias(c) for c in ("leaves", "saved")])
    summed = running_products(along, "conv", ["up"], ["leaves", "saved"], [1, 1], None)
    sums = summed.groupBy(*NODE).agg(F.sum("leaves_upto").alias("n_leaves"), F.sum("saved_upto").alias("saved_tokens"))

    zero = F.lit(0).cast("long")
    ends = rows.where("depth = len").select(*NODE, "conv").join(shared.select(*NODE), NODE, "left_semi").unionByName(
        convs.where("len = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv"))
    ends = cut_lineage(_ends_digest(ends))
    none = F.lit(sha(""))
    many = shared.join(sums, NODE, "left").join(ends, NODE, "left").select(
        *NODE, "q1", "q2", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
    single = nodes.where("n_convs = 1").select(
        *NODE, "q1", "q2", "conv_id", "n_convs", (1 - F.col("n_ends")).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        zero.alias("saved_tokens"), F.when(F.col("n_ends") == 1, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(none).alias("ends_sha256"))
    every_node = cut_lineage(many.unionByName(single))

    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    types = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    top = convs.agg(F.count("*"), F.min("conv")).first()
    below = every_node.where("depth = 1").agg(F.count("*"), F.sum("n_leaves"), F.sum("saved_tokens")).first()
    turnless = ends.where("depth = 0").select("ends_sha256").first()
    root = [] if not top[0] else [(top[1], 0, None, top[0], below[0], below[1] or 1, below[2] or 0, turnless[0] if turnless else sha(""))]
    root_row = turns.sparkSession.createDataFrame(root, types)
    parents = shared.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("shared_parent"))
    found = every_node.join(parents, ["depth", "q1", "q2"], "left").withColumn(
        "parent_conv_id", F.when(F.col("depth") == 1, F.lit(top[1])).otherwise(F.coalesce("shared_parent", "conv_id")))
    return found.select(*out).unionByName(root_row)


_CRC = ("list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), "
        "lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda a, b: xor(a >> 1, 3988292384 * (a & 1))))")
TRIE_SQL = f"""
WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
                      coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, xor({_CRC}, 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
parts AS (SELECT c.conv_id, 0 AS half, t.pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.pos <= c.h
          UNION ALL SELECT c.conv_id, 1, t.pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
built AS (SELECT conv_id, row_number() OVER w AS depth, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words,
                 string_agg(length(role) || ':' || length(text) || ':' || role || text, '' ORDER BY half, pos) OVER w AS path
          FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY half, pos)),
rows_ AS (SELECT conv_id, depth, words, path FROM built UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
sized AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS len FROM rows_),
nodes AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
                 coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = len), '') AS ends FROM sized GROUP BY depth, path),
links AS (SELECT n.depth, n.path, n.conv_id, up.path AS parent_path, up_node.conv_id AS parent_conv_id FROM nodes n
          LEFT JOIN sized up ON up.conv_id = n.conv_id AND up.depth = n.depth - 1
          LEFT JOIN nodes up_node ON up_node.depth = up.depth AND up_node.path = up.path),
kids AS (SELECT depth - 1 AS depth, parent_path AS path, count(*) AS n_children FROM links WHERE depth > 0 GROUP BY ALL),
inside AS (SELECT m.depth, m.path, count(*) FILTER (kids.n_children IS NULL) AS n_leaves, sum((y.n_convs - 1) * y.words) AS saved
           FROM sized m JOIN nodes y ON y.conv_id = m.conv_id AND y.depth >= m.depth LEFT JOIN kids ON kids.depth = y.depth AND kids.path = y.path
           GROUP BY m.depth, m.path)
SELECT n.conv_id, n.depth::BIGINT AS depth, l.parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children,
       i.n_leaves::BIGINT AS n_leaves, i.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN links l USING (depth, path) LEFT JOIN kids k USING (depth, path) JOIN inside i USING (depth, path)"""


@query("op11_prefix_trie", TRIE_SQL)
def op11_prefix_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))

"""A prefix trie over conversations that start with the head of another one.

A conversation is rebuilt from the first turns of a base conversation and its own
turns after as many.  No rebuilt text is ever put together.  A run of turns has a
fingerprint that composes: reading turn t takes a number x to x * B + t, modulo a
prime, so a run of turns is a map x -> a * x + h, and two runs make one by composing
their maps.  The prefix of a rebuilt conversation is the base's map followed by the own
map without its own head, which comes to one product and one sum per turn.  Four
primes of 31 bits give 124 bits.

The same composition joins the parts of a conversation that lie in several tasks: turns
are dealt out by range, so that one of any length is spread, each task takes the
product of its stretch, and the products of the stretches before are put in front.

Nodes of the trie are groups of equal depth and fingerprint.  That their turns are
equal is then verified on the texts, which each row still refers to by conversation and
place: if the last turns in each group are equal, so are, by depth, the whole prefixes.
Should any differ, everything is done again with other multipliers.

What is summed over a subtree is summed over the conversations below a node instead, so
the depth of the trie sets no number of rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from quire.llm.arrow import bound_batches
from quire.session import materialize

PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
LONGEST_HEAD = 8
LOW = (1 << 31) - 1
KEY = ["depth", "f", "g"]


@dataclass(frozen=True)
class Hashing:
    """Multipliers, one for each prime, that follow from a seed."""

    seed: int
    primes: tuple[int, ...] = PRIMES

    @property
    def bases(self) -> list[int]:
        digest = hashlib.sha256(f"turns {self.seed}".encode()).digest()
        drawn = (int.from_bytes(digest[8 * i : 8 * i + 8], "big") for i in range(4))
        return [2 + n % (p - 3) if p > 3 else 2 for n, p in zip(drawn, self.primes)]

    def turn(self, role: Column, text: Column) -> tuple[Column, Column]:
        """Four numbers for a turn, in two longs."""
        words = F.xxhash64(role, text), F.xxhash64(F.lit(self.seed), text, role)
        parts = [p for w in words for p in (F.shiftright(w, 32), w.bitwiseAND(F.lit(LOW)))]
        return pack([F.pmod(x, F.lit(p)) for x, p in zip(parts, self.primes)])

    def each(self, make, *pairs: tuple[Column, Column]) -> tuple[Column, Column]:
        """Apply make(number...) to the four numbers of each pair of longs."""
        rows = zip(self.primes, zip(*(unpack(*pair) for pair in pairs)))
        return pack([F.pmod(make(*row), F.lit(p)) for p, row in rows])

    def undo(self, pair: tuple[Column, Column], turns: Column, most: int) -> tuple[Column, Column]:
        """The numbers divided by the bases to the power of `turns`, from 0 to `most`."""
        out = []
        for x, base, p in zip(unpack(*pair), self.bases, self.primes):
            known = F.array(*(F.lit(pow(base, -i, p)).cast("long") for i in range(most + 1)))
            out.append(F.pmod(x * F.element_at(known, turns.cast("int") + 1), F.lit(p)))
        return pack(out)


def pack(numbers: list[Column]) -> tuple[Column, Column]:
    a, b, c, d = (n.cast("long") for n in numbers)
    return F.shiftleft(a, 31).bitwiseOR(b), F.shiftleft(c, 31).bitwiseOR(d)


def unpack(f: Column, g: Column) -> list[Column]:
    return [x for w in (f, g) for x in (F.shiftright(w, 31), w.bitwiseAND(F.lit(LOW)))]


def packed(numbers: list[int]) -> tuple[int, int]:
    a, b, c, d = numbers
    return a << 31 | b, c << 31 | d


def unpacked(f: int, g: int) -> list[int]:
    return [f >> 31, f & LOW, g >> 31, g & LOW]


def pair(name: str) -> tuple[Column, Column]:
    """The two columns of a packed number."""
    return F.col(name + "f"), F.col(name + "g")


def named(name: str, numbers: tuple[Column, Column]) -> dict[str, Column]:
    return {name + "f": numbers[0], name + "g": numbers[1]}


STRETCH = (
    "part int, serial long, last boolean, conv_id long, place long, bytes long, mf long, "
    "mg long, hf long, hg long, tf long, tg long, size long, role string, text string"
)
MADE = [pa.int32(), pa.int64(), pa.bool_(), *[pa.int64()] * 7]
KEPT = ["tf", "tg", "size", "role", "text"]


def stretches(conversations: DataFrame, hashing: Hashing) -> DataFrame:
    """Turns in order, dealt out by range, with the product of the stretch so far.

    `place` counts the turns of the conversation within the task, `bytes` their length,
    and (m, h) is their map.  `serial` counts a task's rows and `last` marks its end.
    """
    turns = (
        conversations.select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        )
        .filter(F.col("conv_id").isNotNull())
        .withColumns(named("t", hashing.turn(F.col("role"), F.col("text"))))
        .withColumn("size", F.octet_length("text").cast("long"))
    )
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order).drop("turn")
    bases, primes = hashing.bases, hashing.primes
    names = [field.split()[0] for field in STRETCH.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId() if context else 0
        conv, place, serial, total = None, 0, 0, 0
        m = h = [0, 0, 0, 0]
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield held
            rows = []
            columns = [batch.column(n).to_pylist() for n in ("conv_id", "tf", "tg", "size")]
            for conv_id, f, g, size in zip(*columns):
                if conv_id != conv:
                    conv, place, total = conv_id, 0, 0
                    m, h = [1, 1, 1, 1], [0, 0, 0, 0]
                place, serial, total = place + 1, serial + 1, total + size
                m = [x * b % p for x, b, p in zip(m, bases, primes)]
                h = [(x * b + t) % p for x, b, t, p in zip(h, bases, unpacked(f, g), primes)]
                rows.append((part, serial, False, conv_id, place, total, *packed(m), *packed(h)))
            made = [pa.array(c, type=t) for c, t in zip(zip(*rows), MADE)]
            held = pa.RecordBatch.from_arrays([*made, *(batch.column(n) for n in KEPT)], names)
        if held is not None:
            flags = pa.array([False] * (held.num_rows - 1) + [True])
            yield held.set_column(2, "last", flags)

    bound_batches(dealt.sparkSession)
    return materialize(dealt.mapInArrow(run, STRETCH), "turns")


def carried(dealt: DataFrame, hashing: Hashing) -> list[tuple]:
    """For each task that goes on with a conversation: part, conv_id, and the places,
    bytes, m and h of the stretches before.

    Two rows a task come to the driver, as many as there are shuffle partitions.
    """
    edges = dealt.filter("serial = 1 OR last").drop("role", "text").collect()
    parts: dict[int, list] = {}
    for row in sorted(edges, key=lambda r: (r["part"], r["serial"])):
        parts.setdefault(row["part"], []).append(row)
    out, before = [], None
    for part in sorted(parts):
        first, last = parts[part][0], parts[part][-1]
        place, total = last["place"], last["bytes"]
        m, h = unpacked(last["mf"], last["mg"]), unpacked(last["hf"], last["hg"])
        if before and before[0] == first["conv_id"]:
            out.append((part, *before[:3], *packed(before[3]), *packed(before[4])))
            if last["conv_id"] == first["conv_id"]:  # one conversation fills the task
                place, total = place + before[1], total + before[2]
                h = [(c * a + x) % p for c, a, x, p in zip(before[4], m, h, hashing.primes)]
                m = [c * a % p for c, a, p in zip(before[3], m, hashing.primes)]
        before = (last["conv_id"], place, total, m, h)
    return out


def whole_turns(conversations: DataFrame, hashing: Hashing) -> DataFrame:
    """conv_id, place, bytes, m, h, t, size, role, text over whole conversations.

    (m, h) is the map of the turns up to this place, so h is their fingerprint.
    """
    dealt = stretches(conversations, hashing)
    schema = (
        "part int, conv_id long, places long, above long, mf_ long, mg_ long, hf_ long, hg_ long"
    )
    carry = dealt.sparkSession.createDataFrame(carried(dealt, hashing), schema)
    joined = dealt.join(F.broadcast(carry), ["part", "conv_id"], "left")
    goes_on = F.col("places").isNotNull()
    m0, h0 = (F.col("mf_"), F.col("mg_")), (F.col("hf_"), F.col("hg_"))
    m = hashing.each(lambda c, a: c * a, m0, pair("m"))
    h = hashing.each(lambda c, a, x: c * a + x, h0, pair("m"), pair("h"))
    whole = {
        "place": F.col("place") + F.col("places"), "bytes": F.col("bytes") + F.col("above"),
        **named("m", m), **named("h", h),
    }
    return joined.select(
        "conv_id", *(F.when(goes_on, c).otherwise(F.col(n)).alias(n) for n, c in whole.items()),
        "tf", "tg", "size", "role", "text",
    )


def rebuilt(turns: DataFrame, base: Column, head: Column, hashing: Hashing, most: int) -> DataFrame:
    """A row for each conversation: how its prefixes follow from stored ones.

    conv_id, base, head (turns taken from the base), skip (own turns left out), depth,
    total (bytes), heads (the base's first turns, as many as are taken), and shift and
    above, by which own turns' fingerprints and bytes are moved.
    """
    first = F.when(
        F.col("place") <= most,
        F.struct("place", "bytes", "hf", "hg", "tf", "tg", "size"),
    )
    convs = materialize(
        turns.groupBy("conv_id").agg(
            F.max("place").alias("n"), F.max("bytes").alias("n_bytes"),
            F.sort_array(F.collect_list(first)).alias("heads"),
        ),
        "conversations",
    )
    bases = convs.select(
        F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("heads").alias("taken")
    )
    joined = convs.withColumns({"base": base.cast("long"), "skip": head.cast("long")}).join(
        bases, "base", "left"
    )
    head = F.least("skip", F.coalesce("base_n", F.lit(0)))
    full = joined.withColumn("head", head).withColumns(
        {
            "from_base": F.when(F.col("head") > 0, F.element_at("taken", F.col("head").cast("int"))),
            "left_out": F.when(
                (F.col("skip") > 0) & (F.col("n") > F.col("skip")),
                F.element_at("heads", F.col("skip").cast("int")),
            ),
        }
    )

    def number(of: str, name: str) -> Column:
        return F.coalesce(F.col(f"{of}.{name}"), F.lit(0).cast("long"))

    # Without its own head and with the base's, a turn's fingerprint h becomes
    # h + m * shift, where m is its multiplier.
    apart = hashing.each(
        lambda b, o: b - o,
        (number("from_base", "hf"), number("from_base", "hg")),
        (number("left_out", "hf"), number("left_out", "hg")),
    )
    shift = hashing.undo(apart, F.col("skip"), most)
    own = F.greatest(F.col("n") - F.col("skip"), F.lit(0).cast("long"))
    above = number("from_base", "bytes") - number("left_out", "bytes")
    return full.select(
        "conv_id", "base", "head", "skip", (F.col("head") + own).alias("depth"),
        F.when(own > 0, F.col("n_bytes") + above).otherwise(number("from_base", "bytes"))
        .alias("total"),
        F.slice(F.coalesce("taken", F.array()), 1, F.col("head").cast("int")).alias("heads"),
        shift[0].alias("sf"), shift[1].alias("sg"), above.alias("above"),
    )


def prefixes(turns: DataFrame, convs: DataFrame, hashing: Hashing) -> DataFrame:
    """A row for each prefix of each rebuilt conversation, the empty one included.

    conv_id, depth, fingerprint (f, g), t and size of its last turn, bytes of the whole
    prefix, ends (whether it is all of the conversation), and where its last turn is
    stored: at, place.
    """
    whole = F.col("depth") == F.col("whole")
    ends = convs.withColumnRenamed("depth", "whole")
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    root = ends.select(
        "conv_id", zero.alias("depth"), *(zero.alias(n) for n in ("f", "g", "tf", "tg", "size")),
        zero.alias("bytes"), (F.col("whole") == 0).alias("ends"), none.alias("at"),
        none.alias("place"),
    )
    heads = ends.select("conv_id", "base", "whole", F.explode("heads").alias("x")).select(
        "conv_id", F.col("x.place").alias("depth"), F.col("x.hf").alias("f"),
        F.col("x.hg").alias("g"), "x.tf", "x.tg", "x.size", "x.bytes", "whole",
        F.col("base").alias("at"), F.col("x.place").alias("place"),
    )
    f, g = hashing.each(lambda h, m, s: h + m * s, pair("h"), pair("m"), pair("s"))
    own = (
        turns.drop("role", "text").join(ends.drop("heads", "total"), "conv_id")
        .filter(F.col("place") > F.col("skip"))
        .select(
            "conv_id", (F.col("place") - F.col("skip") + F.col("head")).alias("depth"),
            f.alias("f"), g.alias("g"), "tf", "tg", "size",
            (F.col("bytes") + F.col("above")).alias("bytes"), "whole",
            F.col("conv_id").alias("at"), "place",
        )
    )
    columns = root.columns
    return root.union(heads.withColumn("ends", whole).select(columns)).union(
        own.withColumn("ends", whole).select(columns)
    )


def collisions(turns: DataFrame, rows: DataFrame, nodes: DataFrame) -> int:
    """Number of nodes whose last turns are not all equal.

    Only nodes with turns from several places are looked at; their texts are read by
    these places, and a node's least and largest text are compared, which combines
    before the shuffle however many turns a node has.
    """
    several = nodes.filter("several").select(KEY)
    places = (
        rows.filter("at IS NOT NULL").select(*KEY, F.col("at").alias("conv_id"), "place")
        .join(several, KEY, "left_semi").distinct()
    )
    texts = turns.select("conv_id", "place", "role", "text").join(places, ["conv_id", "place"])
    ranges = [f(c).alias(f"{n}_{c}") for c in ("role", "text") for n, f in
              (("least", F.min), ("most", F.max))]
    return (
        texts.groupBy(KEY).agg(*ranges)
        .filter("least_role <> most_role OR least_text <> most_text").count()
    )


def id_digests(ends: DataFrame) -> DataFrame:
    """depth, f, g, ends_sha256 over the ids of conversations that end at a node.

    Ids come in order and are hashed one by one, so any number may end at a node.
    """
    dealt = ends.select(*KEY, "conv_id").repartition(*KEY).sortWithinPartitions(*KEY, "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, done = None, None, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = [pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays(columns, [*KEY, "ends_sha256"])

        for batch in batches:
            for *at, conv_id in zip(*(c.to_pylist() for c in batch.columns)):
                if at == key:
                    digest.update(b",%d" % conv_id)
                    continue
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = at, hashlib.sha256(b"%d" % conv_id)
            if done:
                yield batch_of(done)
                done = []
        if key is not None:
            yield batch_of([(*key, digest.hexdigest())])

    return dealt.mapInArrow(run, "depth long, f long, g long, ends_sha256 string")


def build(
    conversations: DataFrame, base: Column, head: Column, hashing: Hashing, most: int
) -> tuple[DataFrame, int]:
    """The nodes, and how many of them hold prefixes that are not equal."""
    turns = whole_turns(conversations, hashing)
    convs = materialize(rebuilt(turns, base, head, hashing, most), "rebuilt")
    rows = materialize(prefixes(turns, convs, hashing), "prefixes")
    # Size, bytes and last turn follow from the prefix, so any row of a node has them.
    nodes = materialize(
        rows.groupBy(KEY).agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
            F.count_if("ends").alias("n_ends"),
            *(F.max(n).alias(n) for n in ("tf", "tg", "size", "bytes")),
            ((F.min("at") < F.max("at")) | (F.min("place") < F.max("place"))).alias("several"),
        ),
        "nodes",
    )
    wrong = collisions(turns, rows, nodes)

    # A node belongs to its smallest conversation, so what a conversation owns is the
    # end of its path.  Of the texts below a node each conversation repeats those from
    # there to where its own nodes begin.
    leaf = F.col("n_ends") == F.col("n_convs")
    owners = nodes.groupBy("conv_id").agg(
        F.min(F.col("bytes") - F.col("size")).alias("shared"), F.max(leaf.cast("long")).alias("leaf")
    )
    shares = convs.select("conv_id", "total").join(owners, "conv_id", "left").select(
        "conv_id", F.coalesce("shared", "total").alias("shared"),
        F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf"),
    )
    repeated = F.greatest(
        F.col("shared") - (F.col("bytes") - F.col("size")), F.lit(0).cast("long")
    )
    below = rows.join(shares, "conv_id").groupBy(KEY).agg(
        F.sum(repeated).alias("saved_tokens"), F.sum("leaf").alias("n_leaves")
    )
    apart = hashing.each(lambda h, t: h - t, (F.col("f"), F.col("g")), pair("t"))
    up = hashing.undo(apart, F.lit(1), 1)
    children = nodes.filter("depth > 0").select(
        *KEY, (F.col("depth") - 1).alias("depth_"), up[0].alias("f_"), up[1].alias("g_")
    )
    n_children = children.groupBy("depth_", "f_", "g_").agg(F.count("*").alias("n_children"))
    parents = nodes.select(
        F.col("depth").alias("depth_"), F.col("f").alias("f_"), F.col("g").alias("g_"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    parent = children.join(parents, ["depth_", "f_", "g_"]).select(*KEY, "parent_conv_id")
    digests = id_digests(rows.filter("ends"))
    found = (
        nodes.join(below, KEY).join(parent, KEY, "left")
        .join(n_children.toDF(*KEY, "n_children"), KEY, "left").join(digests, KEY, "left")
    )
    return (
        found.select(
            "conv_id", "depth", "parent_conv_id", "n_convs",
            F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
            "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        ),
        wrong,
    )


def prefix_trie(
    conversations: DataFrame,
    base: Column | None = None,
    head: Column | None = None,
    longest_head: int = LONGEST_HEAD,
    attempts: tuple[Hashing, ...] = (Hashing(1), Hashing(2), Hashing(3)),
) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations(conv_id, turn, role, text).

    A conversation is rebuilt as the first `head` turns of conversation `base`, both
    expressions over conv_id (by default itself and none), then its own turns after its
    first `head`.  Turns are in order of turn, null first; equal numbers by role and
    text, and repeated rows are turns of their own.  A null role or text is empty.  Rows
    without a conv_id belong to no conversation and are left out; an absent base gives
    no turns.  `head` is at most `longest_head`, of which that many places of each
    conversation are gathered.

    conv_id is the smallest member; depth, parent_conv_id (root: null), n_convs,
    n_children, n_leaves (childless nodes in the subtree, itself included),
    saved_tokens (over the subtree, bytes of the last text for each member but one) and
    ends_sha256 (of the ids that end here, in order, joined by commas).  The root is
    there if any conversation is; no conversations give no rows.

    Raises RuntimeError if prefixes that differ have equal fingerprints in every attempt.
    """
    base = F.col("conv_id") if base is None else base
    head = F.lit(0) if head is None else head
    for hashing in attempts:
        nodes, wrong = build(conversations, base, head, hashing, longest_head)
        if not wrong:
            return nodes
    raise RuntimeError(f"fingerprints of {wrong} prefixes are not unique")

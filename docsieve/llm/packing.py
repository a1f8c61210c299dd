"""Problem 6: texts into containers of fixed capacity, by bounded-space online best fit."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.plans.durable import durable

#: Vocabulary of the byte-level BPE that counts tokens; it is sent to the executors.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that tokenizer cuts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Bins:
    """At most ``most`` open bins; a bitset says which amounts of free space there are."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.count, self.made = 0, 0, 0
        self.by_space: dict[int, list[int]] = {}

    def put(self, size: int) -> int:
        """The number of the bin that an item of ``size`` <= capacity goes to: the fullest where it fits."""
        fitting = self.bits >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(space)
        else:
            if self.count == self.most:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            bin_, space = self.made, self.capacity
            self.made += 1
        if space > size:
            self.by_space.setdefault(space - size, []).append(bin_)
            self.bits |= 1 << (space - size)
            self.count += 1
        return bin_

    def whole(self) -> int:
        """The number of a bin that is filled at once."""
        self.made += 1
        return self.made - 1

    def _take(self, space: int) -> int:
        bins = self.by_space[space]
        bin_ = bins.pop()
        self.count -= 1
        if not bins:
            del self.by_space[space]
            self.bits &= ~(1 << space)
        return bin_

    def open(self) -> list[tuple[int, int]]:
        """``(bin, load)`` of the bins still open."""
        return [(b, self.capacity - space) for space, bins in sorted(self.by_space.items()) for b in bins]


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(id, tokens)``: the length of each whole text in tokens; 0 for null and empty texts. Rows with null ids are left out."""
    kind = dict(df.dtypes)[id_col]
    source = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    df.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(SparkFiles.get(name), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coder = tiktoken.Encoding("counting", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(coder.encode_ordinary(t)) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64())], names=["id", "tokens"])

    return source.mapInArrow(count, f"id {kind}, tokens long")


def packed_containers(items: DataFrame, capacities: int | dict[int, int], open_bins: int = 64, shard_rows: int = 10_000, shards_at_once: int = 64) -> DataFrame:
    """``(size_id, id, part, token_from, tokens, container)``: each item ``(id, tokens)`` in a container of each capacity.

    ``capacities`` gives the tokens that fit for each ``size_id``; a single number has ``size_id`` 0. All capacities are packed in one pass over the items.
    An item above the capacity is split into full containers and a rest; no other item is split. Items of size 0 go where
    there is room. Items are spread over shards by id; each shard is packed online in the order of ids with at most
    ``open_bins`` open bins, of which the fullest closes first. The bins still open at the end of a shard are items of the next level, which packs those of
    ``shards_at_once`` shards in the same way, in the order of shards, until one level has a single task.
    Repeated ids count once with their largest size; null and negative sizes count as 0. The result
    depends on the items only, not on how they are partitioned. An empty table gives an empty result.
    """
    capacities = {0: capacities} if isinstance(capacities, int) else dict(capacities)
    if min(capacities.values(), default=1) < 1:
        raise ValueError("capacity must be at least 1")
    kind = dict(items.dtypes)["id"]
    clean = items.where("id is not null").groupBy("id").agg(F.greatest(F.lit(0), F.coalesce(F.max("tokens"), F.lit(0))).cast("long").alias("tokens"))
    shards = max(1, -(-items.count() // shard_rows))
    sharded = clean.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "id"), F.lit(shards)).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, sizes, shard = table.column("id"), table.column("tokens").to_pylist(), table.column("shard")[0].as_py()
        source, size_ids, bin_, part, start, length, left = [], [], [], [], [], [], []
        for size_id, capacity in sorted(capacities.items()):
            bins = Bins(capacity, open_bins)
            for row, tokens in enumerate(sizes):
                at = number = 0
                while tokens - at > capacity:
                    source.append(row), bin_.append(bins.whole()), part.append(number), start.append(at), length.append(capacity)
                    number, at = number + 1, at + capacity
                source.append(row), bin_.append(bins.put(tokens - at)), part.append(number), start.append(at), length.append(tokens - at)
            size_ids += [size_id] * (len(source) - len(size_ids))
            left += [(size_id, b, load) for b, load in bins.open()]
        n, m = len(source), len(left)
        ints = lambda values, width=pa.int64(): pa.array(values, width)
        placed = pa.table({"size_id": ints(size_ids, pa.int32()), "shard": ints([shard] * n, pa.int32()), "bin": ints(bin_), "load": pa.nulls(n, pa.int64()), "id": ids.take(ints(source)), "part": ints(part, pa.int32()), "token_from": ints(start), "tokens": ints(length)})
        held = pa.table({"size_id": ints([x[0] for x in left], pa.int32()), "shard": ints([shard] * m, pa.int32()), "bin": ints([x[1] for x in left]), "load": ints([x[2] for x in left]), "id": pa.nulls(m, ids.type), "part": pa.nulls(m, pa.int32()), "token_from": pa.nulls(m, pa.int64()), "tokens": pa.nulls(m, pa.int64())})
        return pa.concat_tables([placed, held])

    placed = durable(sharded.groupBy("shard").applyInArrow(pack, f"size_id int, shard int, bin long, load long, id {kind}, part int, token_from long, tokens long"))

    def repack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("shard", "ascending"), ("bin", "ascending")])
        bins, host, last = Bins(capacities[table.column("size_id")[0].as_py()], open_bins), {}, {}
        rows = list(zip(*(table.column(c).to_pylist() for c in ("shard", "bin", "load")), strict=True))
        to = [host.setdefault(bins.put(load), (shard, bin_)) for shard, bin_, load in rows]
        for number, load in bins.open():
            last[host[number]] = load
        columns = list(zip(*[(s, b, *t, last.get(t)) if (s, b) == t else (s, b, *t, None) for (s, b, _), t in zip(rows, to, strict=True)], strict=True))
        made = {n: pa.array(c, k) for n, c, k in zip(("shard", "bin", "to_shard", "to_bin", "load"), columns, (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)}
        return pa.table({"size_id": table.column("size_id"), **made})

    # what is open goes up level by level; each bin ends up in the one that took it last
    open_ = placed.where("load is not null").select("size_id", "shard", "bin", "load")
    moves, groups, width = None, shards, 1
    while groups > 1:
        groups, width = -(-groups // shards_at_once), width * shards_at_once
        step = durable(open_.groupBy("size_id", F.floor(F.col("shard") / width).alias("bundle")).applyInArrow(repack, "size_id int, shard int, bin long, to_shard int, to_bin long, load long"))
        hop = step.select("size_id", F.col("shard").alias("to_shard"), F.col("bin").alias("to_bin"), F.col("to_shard").alias("next_shard"), F.col("to_bin").alias("next_bin"))
        own = step.select("size_id", "shard", "bin", "to_shard", "to_bin")
        if moves is not None:
            own = moves.join(hop, ["size_id", "to_shard", "to_bin"], "left").select("size_id", "shard", "bin", F.coalesce("next_shard", "to_shard").alias("to_shard"), F.coalesce("next_bin", "to_bin").alias("to_bin"))
        moves, open_ = own, step.where("load is not null").select("size_id", "shard", "bin", "load")
    found = placed.where("load is null")
    found = found.withColumn("to_shard", F.lit(None).cast("int")).withColumn("to_bin", F.lit(None).cast("long")) if moves is None else found.join(moves, ["size_id", "shard", "bin"], "left")
    container = F.concat_ws("-", F.coalesce("to_shard", "shard").cast("string"), F.coalesce("to_bin", "bin").cast("string"))
    return found.select("size_id", "id", "part", "token_from", "tokens", container.alias("container"))

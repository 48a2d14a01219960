"""TAR shards as a table of scenes, planned by rank and epoch.

The reader plans: the shards that have an inventory are ordered anew for each epoch by a hash of seed, epoch and name, and dealt to the
ranks in turn, so ranks share no shard. A partition is a run of one rank's shards, up to ``EACH`` of them or ``TASK_BYTES`` together, which a worker
streams one after the other, member by member; a scene's members lie together and become one row.
"""

from __future__ import annotations

import hashlib
import tarfile
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..registry import query
from .files import TASK_BYTES, scratch, write_files
from .formats import SHARD_ROWS, packed, shard_scenes
from .tail import located


#: Shards to a partition at most.
EACH = 256


class Shards(InputPartition):
    """Neighbouring shards of one rank, the first at ``place``; names are below ``root`` and without their ending."""

    def __init__(self, rank: int, place: int, root: str, names: list[str]):
        super().__init__((rank, place))
        self.rank, self.place, self.root, self.names = rank, place, root, names


class ShardReader(DataSourceReader):
    """Options: ``path``, ``world`` (ranks), ``epoch``, ``seed``, and ``rank`` for one rank's shards alone."""

    def __init__(self, options: dict):
        self.path, self.seed = options["path"], options.get("seed", "0")
        self.world, self.epoch = int(options.get("world", 1)), int(options.get("epoch", 0))
        self.only = int(options["rank"]) if "rank" in options else None

    def partitions(self) -> list[Shards]:
        fs, root = located(self.path)
        root = root.rstrip("/")
        files = {f.path: f.size for f in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)) if f.is_file}
        whole = [f[len(root) + 1 : -4] for f in files if f.endswith(".tar") and f"{f[:-4]}.idx" in files]
        order = sorted(whole, key=lambda name: (hashlib.sha256(f"{self.seed}:{self.epoch}:{name}".encode()).hexdigest(), name))
        plan = []
        for rank in range(self.world) if self.only is None else [self.only]:
            held = 0
            for place, name in enumerate(order[rank :: self.world]):
                if not place or len(plan[-1].names) >= EACH or held >= TASK_BYTES:
                    plan.append(Shards(rank, place, root, []))
                    held = 0
                plan[-1].names.append(name)
                held += files[f"{root}/{name}.tar"]
        return plan

    def read(self, partition: Shards) -> Iterator[tuple]:
        fs, _ = located(self.path)
        for place, name in enumerate(partition.names, partition.place):
            with fs.open_input_stream(f"{partition.root}/{name}.tar") as stream:
                for sample, (scene, members) in enumerate(scenes(stream)):
                    yield self.epoch, partition.rank, place, name, sample, scene, members


def scenes(stream: pyarrow.NativeFile) -> Iterator[tuple[str, dict[str, bytes]]]:
    """Folder and members of each scene of a TAR stream."""
    scene, members = None, {}
    with tarfile.open(fileobj=stream, mode="r|") as tar:
        for member in tar:
            if not member.isfile():
                continue
            of, _, name = member.name.rpartition("/")
            if members and of != scene:
                yield scene, members
                members = {}
            scene = of
            members[name] = tar.extractfile(member).read()
    if members:
        yield scene, members


class ShardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "orrery_shards"

    def schema(self) -> str:
        return "epoch long, rank long, place long, shard string, sample long, scene string, members map<string, binary>"

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options)


@query(f"""WITH n AS (SELECT c_nationkey AS source, c_custkey AS scene, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS k, c_name, c_mktsegment FROM customer),
s AS (SELECT format('source_{{}}/shard_{{:05d}}', source, k // {SHARD_ROWS}) AS shard, k % {SHARD_ROWS} AS sample, scene, c_name, c_mktsegment FROM n),
o AS (SELECT epoch, shard, row_number() OVER (PARTITION BY epoch ORDER BY sha256('7:' || epoch || ':' || shard), shard) - 1 AS turn FROM (SELECT DISTINCT shard FROM s), (SELECT unnest(range(2)) AS epoch))
SELECT epoch, turn % 4 AS rank, turn // 4 AS place, shard, sample, 'scene_' || scene AS scene, c_name AS title, c_mktsegment AS segment FROM s JOIN o USING (shard)""")
def src_shard_stream(spark, sf_dir):
    """Two epochs of four ranks over the same shards."""
    path = scratch(spark, "stream")
    write_files(shard_scenes(spark, sf_dir), path, packed)
    spark.dataSource.register(ShardSource)
    read = lambda epoch: spark.read.format("orrery_shards").options(path=path, world=4, epoch=epoch, seed=7).load()
    said = lambda name: F.col("members")[name].cast("string")
    return read(0).union(read(1)).select("epoch", "rank", "place", "shard", "sample", "scene", F.get_json_object(said("meta.json"), "$.title").alias("title"), said("view_0.txt").alias("segment"))

"""What the operators of this subpackage share: table access, the shared scratch folder, coded words, bounded memos."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20  #: of rows that a Python worker gets at a time, however long their texts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; the session's Arrow batches, if they are as large as Spark has them, are bounded more closely first."""
    if spark.conf.get(BATCH, None) in (None, "67108864b"):
        spark.conf.set(BATCH, str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where the session names none, a session on one machine (master local) gets a temporary folder, which is set;
    on a cluster there is no folder that could be made up, so that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df as a table in the shared folder, read back: lineage ends there and survives lost executors."""
    path = scratch(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read again."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for t in tables:
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            path = hadoop.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def collected(spark: SparkSession) -> None:
    """Lets the executors' JVMs collect their garbage and give back heap that they no longer need, which they don't do of
    their own accord: what sorts and joins made them grow to would stand beside the Python workers of whatever runs next.
    There is a task for each core, of which an idle cluster gives every executor some; one that gets none keeps its heap."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).collect()


def coded(lists: list[list], kind: pa.DataType | None = None) -> tuple[list, np.ndarray, np.ndarray]:
    """Distinct words of lists of words, the place of each word of all lists among them, and the lists' sizes."""
    flat = pa.array(chain.from_iterable(lists), kind or pa.large_string()).dictionary_encode()
    return flat.dictionary.to_pylist(), flat.indices.to_numpy(), np.fromiter(map(len, lists), np.int64, len(lists))


def gathered(values: list[bytes], at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned 32-bit numbers of values[at] in a row, and how many each of the lists that `size` cuts `at` into has."""
    pool = np.frombuffer(b"".join(values), "<u4")
    n = np.fromiter(map(len, values), np.int64, len(values)) >> 2
    first = np.cumsum(n) - n
    n, first = n[at], first[at]
    ends = np.r_[0, np.cumsum(n)]
    flat = pool[np.repeat(first - ends[:-1], n) + np.arange(ends[-1])] if ends[-1] else np.zeros(0, "<u4")
    cut = np.r_[0, np.cumsum(size)]
    return flat, np.diff(ends[cut])


class Memo:
    """Values of words, in two generations of half of `most` bytes each: when the young one is full it becomes the old
    one, whose words move back as they are met. Words of more than `longest` characters aren't remembered."""

    COST = 220  #: bytes of an entry besides its characters: two objects' heads and the table's slots

    def __init__(self, most: int, longest: int = 64):
        self.most, self.longest = most, longest
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def values(self, words: list[str], make: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """Values of distinct words; make gives those of unknown ones."""
        if self.held > self.most // 2:
            self.young, self.old, self.held = {}, self.young, 0
        out = list(map(self.young.get, words))
        lack = [i for i, v in enumerate(out) if v is None]
        fresh = []
        for i in lack:
            out[i] = self.old.get(words[i])
            if out[i] is None:
                fresh.append(i)
        if fresh:
            for i, v in zip(fresh, make([words[i] for i in fresh])):
                out[i] = v
        for i in lack:
            if len(words[i]) <= self.longest:
                self.young[words[i]] = out[i]
                self.held += self.COST + len(words[i]) + len(out[i])
        return out


_memos: dict[str, Memo] = {}
_models: dict[str, object] = {}


def memo(name: str, most: int = 64 << 20) -> Memo:
    """The memo of this worker process under a name. A worker keeps one: asking for another name lets go of it."""
    if name not in _memos:
        _memos.clear()
        _memos[name] = Memo(most)
    return _memos[name]


def model(name: str, make: Callable[[], object]):
    """A tokenizer or vocabulary that a worker process keeps from task to task. It keeps one, and the memos made with it:
    Python workers are used again by later jobs, and what each operator loads must not add up there."""
    if name not in _models:
        _models.clear()
        _memos.clear()
        trimmed()  # of what tasks of other operators held as well
        _models[name] = make()
        trimmed()  # of what building it took
    return _models[name]


def released() -> None:
    """Lets go of what this worker process keeps, and gives the memory back; operators that keep nothing begin with it."""
    _models.clear()
    _memos.clear()
    trimmed()


def trimmed() -> None:
    """Gives the memory of what nothing refers to back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)

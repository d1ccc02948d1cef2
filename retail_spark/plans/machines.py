"""Factorisation machines for two classes (ML8) by passes over packed rows.

The model, its starting values, loss and steps (AdamW) are those of MLlib's ``FMClassifier``.  Rows are written once as
blocks of some ten thousand.  A row's vector may be given in two parts, of which the second one (an item) comes with many
first ones (contexts): a block holds its different contexts, its different items, and for each pair the rows and the sum
of their labels.  With S the weighted sum of a part's factors, |S_c + S_i|^2 = |S_c|^2 + 2 S_c S_i + |S_i|^2, so raw
predictions of all pairs are one product, and a context's entries are looked up and their gradients added up once for all
its rows.  Each task adds up the gradient of its blocks, Spark merges the tasks' sums, and the driver takes the step.
What the driver and each task hold is the model (buckets x (factors + 1) numbers for each machine) and some blocks.
Several machines over the same rows advance in the same passes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_spark.session import stored

SEED = 42
FACTORS, STEP, DECAY, PASSES, TOL = 20, 0.05, 0.001, 50, 1e-6
PACK = 1 << 15         # rows in a block
# Parquet's reader holds a row group's rows at once, whatever their width: a few blocks, not thousands
_GROUPS = {"parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "1"}


@dataclass
class Machine:
    factors: np.ndarray        # buckets, factors
    linear: np.ndarray         # buckets
    intercept: float


def _start(df: DataFrame, buckets: int) -> Machine:
    """The starting values that MLlib draws for this number of buckets."""
    one = df.sparkSession.createDataFrame([(Vectors.sparse(buckets, [], []), 0.0)], ["features", "label"])
    m = FMClassifier(factorSize=FACTORS, maxIter=0, seed=SEED).fit(one)
    return Machine(m.factors.toArray(), m.linear.toArray(), m.intercept)


def _cells(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the i-th vector of each row, padded by zeros to the longest: entries x rows."""
    at, value = batch.column(f"i{i}"), batch.column(f"v{i}")
    size = np.diff(at.offsets.to_numpy())
    there = np.arange(size.max(initial=1)) < size[:, None]
    index, values = np.zeros(there.shape, np.int32), np.zeros(there.shape)
    index[there], values[there] = at.flatten().to_numpy(), value.flatten().to_numpy()
    return index.T, values.T


def _vectors(df: DataFrame, cols: Sequence[str], keep: Sequence[str], sized: bool = False) -> DataFrame:
    plain = [F.unwrap_udt(c) for c in cols]
    size = [plain[0]["size"].alias("size")] if sized else []
    return df.select(*keep, *size, *[p["indices"].alias(f"i{i}") for i, p in enumerate(plain)], *[p["values"].alias(f"v{i}") for i, p in enumerate(plain)])


def _small(x: np.ndarray) -> bytes:
    """Numbers as the smallest kind that holds them all."""
    low, high = x.min(initial=0), x.max(initial=0)
    for kind in (np.uint8, np.uint16, np.uint32):
        if low >= 0 and high <= np.iinfo(kind).max and (x.dtype.kind in "iu" or (x == np.floor(x)).all()):
            return np.ascontiguousarray(x, kind).tobytes()
    return np.ascontiguousarray(x, np.float64).tobytes()


_KINDS = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.float64}


def _read(data: pa.Scalar, n: int) -> np.ndarray:
    raw = data.as_buffer()
    return np.frombuffer(raw, _KINDS[raw.size // n] if n else np.uint8)


def _different(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ones among sparse rows (entries x rows, without order, zeros are no entries), and the number of each row's."""
    place = np.argsort(np.where(values == 0, np.iinfo(np.int32).max, index), axis=0, kind="stable")
    index, values = (np.take_along_axis(x, place, axis=0) for x in (np.where(values == 0, 0, index), values))
    longest = max(1, int((values != 0).sum(axis=0).max(initial=1)))
    rows = np.ascontiguousarray(np.concatenate([index[:longest].astype(np.int64), values[:longest].view(np.int64)]).T)
    mixed = np.random.default_rng(SEED).integers(1, 1 << 62, rows.shape[1]) | 1
    key = rows @ mixed
    _, first, of = np.unique(key ^ (key >> 29), return_index=True, return_inverse=True)
    if not (rows[first[of]] == rows).all():              # two rows of one hash
        _, first, of = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    return index[:longest, first].T, values[:longest, first].T, of.ravel()


def _apart(index: np.ndarray, values: np.ndarray, item: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries x rows: the values without the item's, the item's indices and its values; a row whose item's entries are not
    found as they are (another column meets one in its bucket) stays whole and has an empty item."""
    taken, found = np.zeros(index.shape, bool), np.ones(index.shape[1], bool)
    for at, v in zip(item, weight):
        here = (index == at) & (values == v) & (v != 0)
        taken |= here
        found &= here.any(axis=0) | (v == 0)
    return np.where(taken & found, 0.0, values), np.where(found, item, 0), np.where(found, weight, 0.0)


_PARTS = ("shape", "ci", "cv", "ii", "iv", "cell", "n", "p")


def _block(index: np.ndarray, values: np.ndarray, item: np.ndarray, weight: np.ndarray, label: np.ndarray) -> list[bytes]:
    """``_PARTS`` of some rows: contexts and items (indices and values), pairs, rows and sum of the labels of each pair."""
    values, item, weight = _apart(index, values, item, weight)
    ci, cv, context = _different(index, values)
    ii, iv, of = _different(item, weight)
    cell, place = np.unique(context * len(ii) + of, return_inverse=True)
    return [np.array([*ci.shape, *ii.shape, len(cell)], np.int64).tobytes(), _small(ci), _small(cv), _small(ii), _small(iv), _small(cell),
            _small(np.bincount(place)), _small(np.bincount(place, label))]


def _unpacked(batch: pa.RecordBatch, r: int, i: int) -> list[np.ndarray]:
    k, e, j, f, n = np.frombuffer(batch.column(f"shape{i}")[r].as_buffer(), np.int64)
    ci, cv, ii, iv, cell, rows, label = (_read(batch.column(f"{c}{i}")[r], m) for c, m in zip(_PARTS[1:], (k * e, k * e, j * f, j * f, n, n, n)))
    return [ci.reshape(k, e), cv.reshape(k, e), ii.reshape(j, f), iv.reshape(j, f), cell.astype(np.intp), rows, label]


def _packed(df: DataFrame, cols: Sequence[str], label: str, parts: Sequence[str] | None = None) -> DataFrame:
    """Blocks of rows; ``parts``: for each vector column one with its item's entries."""
    names, items = [f"{c}{i}" for i in range(len(cols)) for c in _PARTS], list(dict.fromkeys(parts or []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            some = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            y, out = some.column("label").to_numpy(), []
            for i in range(len(cols)):
                item = _cells(some, len(cols) + items.index(parts[i])) if parts else (np.zeros((1, some.num_rows), np.int32), np.zeros((1, some.num_rows)))
                out += _block(*_cells(some, i), *item, y)
            return pa.record_batch([some.column("size")[:1], *[pa.array([x], pa.binary()) for x in out]], names=["size", *names])

        for batch in batches:
            for at in range(0, batch.num_rows, PACK):
                held.append(batch.slice(at, PACK))
                if sum(b.num_rows for b in held) >= PACK:
                    yield block()
        if held:
            yield block()

    rows = _vectors(df.withColumn("label", F.col(label).cast("double")), [*cols, *items], ["label"], sized=True)
    return stored(rows.mapInArrow(run, "size int, " + ", ".join(f"{c} binary" for c in names)), "blocks", _GROUPS)


def _raw(m: Machine, index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Raw predictions of rows, and their sums of weighted factors (rows x factors)."""
    norm = (m.factors * m.factors).sum(axis=1)
    raw, sums = np.full(index.shape[1], m.intercept), np.zeros((index.shape[1], m.factors.shape[1]))
    for at, v in zip(index, values):
        some = np.take(m.factors, at, axis=0)
        sums += some if (v == 1).all() else some * v[:, None]
        raw += m.linear[at] * v - 0.5 * norm[at] * v * v
    return raw + 0.5 * (sums * sums).sum(axis=1), sums


def _sigmoid(raw: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-raw))


def _table(m: Machine) -> np.ndarray:
    """Factors, linear weight and squared length of the factors of each bucket."""
    return np.column_stack([m.factors, m.linear, (m.factors * m.factors).sum(axis=1)])


def _part(table: np.ndarray, index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of weighted factors of sparse rows (rows x entries), and what they are in a raw prediction by themselves."""
    got = np.zeros((len(index), table.shape[1]))
    for at, v in zip(index.T, values.T):
        some = np.take(table, at, axis=0)
        got += some if (v == 1).all() else some * v[:, None]
        if not ((v == 0) | (v == 1)).all():       # squared lengths count with squared values
            v = v.astype(float)
            got[:, -1] += (v * v - v) * some[:, -1]
    sums = np.ascontiguousarray(got[:, :-2])
    return sums, got[:, -2] + 0.5 * ((sums * sums).sum(axis=1) - got[:, -1])


def _spread(out: np.ndarray, index: np.ndarray, values: np.ndarray, moved: np.ndarray, slopes: np.ndarray) -> None:
    """Adds to the buckets of rows' entries (rows x entries) what the rows moved, times values, their slopes times values, and times
    squared values."""
    entry, row = np.nonzero(values.T)
    at, v = index.T[entry, row], values.T[entry, row]
    order = np.argsort(at, kind="stable")
    at, v = at[order], v[order]
    some = np.column_stack([moved, slopes, slopes]).take(row[order], axis=0)
    if not (v == 1).all():
        some *= v.astype(float)[:, None]
        some[:, -1] *= v
    first = np.flatnonzero(np.diff(at.astype(np.int64), prepend=-1))
    size = np.diff(first, append=len(at))
    for a, n in zip(first[size > 16], size[size > 16]):
        out[at[a]] += some[a:a + n].sum(axis=0)
    first, size = first[size <= 16], size[size <= 16]
    for n in range(size.max(initial=0)):           # the n-th rows of all other buckets: no bucket twice
        here = first[size > n] + n
        out[at[here]] += some[here]


def _slopes(m: Machine, c: tuple[np.ndarray, np.ndarray], i: tuple[np.ndarray, np.ndarray], cell: np.ndarray, n: np.ndarray,
            label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For contexts and for items (sums, raw): the summed slopes of their raw predictions times sums, and those slopes."""
    (s, base), (t, more) = c, i
    k, j = len(s), len(t)
    if k * j <= 16 * len(cell):                   # most pairs are there: products of whole tables
        table = s @ t.T
        table += base[:, None]
        table += more + m.intercept
        raw, table = table.ravel()[cell], np.zeros(k * j)
        table[cell] = n * _sigmoid(raw) - label
        table = table.reshape(k, j)
        own, items = table.sum(axis=1), table.sum(axis=0)
        return table @ t + own[:, None] * s, own, table.T @ s + items[:, None] * t, items
    a, b = np.divmod(cell, j)
    g = n * _sigmoid((s[a] * t[b]).sum(axis=1) + base[a] + more[b] + m.intercept) - label
    own, items = np.bincount(a, g, k), np.bincount(b, g, j)
    order = np.argsort(b, kind="stable")
    first = lambda x: np.flatnonzero(np.diff(x, prepend=-1))
    return (np.add.reduceat(g[:, None] * t[b], first(a), axis=0) + own[:, None] * s, own,
            np.add.reduceat(g[order, None] * s[a[order]], first(b[order]), axis=0) + items[:, None] * t, items)


def _gradients(blocks: DataFrame, machines: dict[int, Machine]) -> tuple[dict[int, np.ndarray], int]:
    """For each machine the summed gradient (buckets + 1 rows: the last one for the intercept; factors, then linear), and the rows."""
    sent = blocks.sparkSession.sparkContext.broadcast(machines)
    buckets = len(next(iter(machines.values())).linear)
    names = [f"g{f}" for f in range(FACTORS + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = 0
        held = {i: np.zeros((buckets, FACTORS + 2)) for i in sent.value}       # factors, linear, squares
        tables = {i: _table(m) for i, m in sent.value.items()}
        whole = dict.fromkeys(held, 0.0)
        for batch in batches:
            for r in range(batch.num_rows):
                for at, (i, m) in enumerate(sent.value.items()):
                    ci, cv, ii, iv, cell, n, label = _unpacked(batch, r, i)
                    rows += int(n.sum()) if at == 0 else 0
                    moved, own, item_moved, items = _slopes(m, _part(tables[i], ci, cv), _part(tables[i], ii, iv), cell, n, label)
                    whole[i] += own.sum()
                    _spread(held[i], ci, cv, moved, own)
                    _spread(held[i], ii, iv, item_moved, items)
        for i, out in held.items() if rows else ():
            out[:, :FACTORS] -= out[:, FACTORS + 1:] * sent.value[i].factors
            seen = np.flatnonzero(out.any(axis=1))
            table = np.concatenate([out[seen, :FACTORS + 1].T, np.zeros((FACTORS + 1, 1))], axis=1)
            table[FACTORS, -1] = whole[i]
            which = np.concatenate([seen, [buckets]])
            yield pa.record_batch([pa.array(np.full(len(which), i)), pa.array(which), pa.array(np.where(which == buckets, rows, 0)),
                                   *[pa.array(c) for c in table]], names=["m", "bucket", "n", *names])

    got = (blocks.mapInArrow(run, "m long, bucket long, n long, " + ", ".join(f"{c} double" for c in names)).groupBy("m", "bucket")
           .agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).toArrow())
    sent.destroy()
    which, at, table = got["m"].to_numpy(), got["bucket"].to_numpy(), np.stack([got[c].to_numpy() for c in names], axis=1)
    out = {i: np.zeros((buckets + 1, FACTORS + 1)) for i in machines}
    for i, sums in out.items():
        sums[at[which == i]] = table[which == i]
    return out, int(got["n"].to_numpy().sum()) // max(1, len(machines))


def fit_machines(train: DataFrame, cols: Sequence[str], label: str = "label", parts: Sequence[str] | None = None) -> list[Machine]:
    """A machine for each vector column of ``train`` (20 factors), all advanced by the same passes.

    ``parts`` names for each a vector column with those of its entries that come with many others (an item's); results are
    the same without."""
    blocks = _packed(train, cols, label, parts)
    size = blocks.select("size").first()[0]
    # one sum for each core: more tasks would only add sums of the model's size
    blocks = blocks.drop("size").coalesce(train.sparkSession.sparkContext.defaultParallelism)
    first = _start(train, size)
    now = [np.append(np.column_stack([first.factors, first.linear]).ravel(), first.intercept) for _ in cols]
    mean, square, open_ = [np.zeros_like(w) for w in now], [np.zeros_like(w) for w in now], list(range(len(cols)))
    machine = lambda w: Machine(*(lambda t: (np.ascontiguousarray(t[:, :FACTORS]), t[:, FACTORS].copy()))(w[:-1].reshape(size, -1)), float(w[-1]))
    for turn in range(1, PASSES + 1):
        if not open_:
            break
        sums, n = _gradients(blocks, {i: machine(now[i]) for i in open_})
        for i in list(open_):
            g = np.append(sums[i][:-1].ravel(), sums[i][-1, FACTORS]) / n
            mean[i], square[i] = 0.9 * mean[i] + 0.1 * g, 0.999 * square[i] + 0.001 * g * g
            step = STEP * (mean[i] / (1 - 0.9 ** turn)) / (np.sqrt(square[i] / (1 - 0.999 ** turn)) + 1e-8) + DECAY * now[i]
            now[i] = now[i] - step
            if np.linalg.norm(step) < TOL * max(np.linalg.norm(now[i]), 1.0):
                open_.remove(i)
    return [machine(w) for w in now]


def with_raw(df: DataFrame, col: str, machine: Machine, keep: Sequence[str]) -> DataFrame:
    """``keep`` of each row with ``raw`` and ``score``, the probability of class 1."""
    sent = df.sparkSession.sparkContext.broadcast(machine)
    types = dict(df.select(*keep).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw, _ = _raw(sent.value, *_cells(batch, 0))
                yield pa.record_batch([*[batch.column(c) for c in keep], pa.array(raw), pa.array(_sigmoid(raw))], names=[*keep, "raw", "score"])

    return _vectors(df, [col], keep).mapInArrow(run, ", ".join([f"`{c}` {types[c]}" for c in keep] + ["raw double", "score double"]))

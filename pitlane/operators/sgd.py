"""Training by mini-batch Adam: gradients are summed where the rows lie, the optimiser's state goes on from step to step.

Several models are fitted side by side in one pass over the rows: windows, seeds, targets and ways of
weighting are models of one stack, each with its own label and weight of a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.scratch import scratch, stored
from . import metrics
from .nets import Params, Totals, objective, totals

#: Values of fields are hashed to so many bits, and all models of a stack together have at most so many rows of embeddings.
BITS, MOST_ROWS = 20, 1 << 21
#: Partial gradients that meet on the driver; if there are more, they are summed in tasks first, by blocks of so many rows of a table.
FAN_IN, BLOCK = 64, 1 << 16
#: Gradients that all steps of a fit may send to the driver; where they might be more, the tables lie in parts (see Parts), each for about so many rows.
DRIVER_BYTES, ROWS_OF_PART = 500_000_000, 1 << 17
#: Gradients of shared codes that all steps of a fit with parts may send to the driver; further codes lie in parts too, which lend them to each other.
SHARED_BYTES = 100_000_000
#: Rows that a task computes at once.
ROWS_AT_ONCE = 2048
#: Lists longer than this are cut by chance into shorter ones.
LONGEST = 32


def code(place: int, value: Column, bits: int = BITS) -> Column:
    """The hashed code of a field's value; the field's place keeps equal values of different fields apart."""
    return F.pmod(F.xxhash64(F.lit(place), value), F.lit(1 << bits)).cast("int")


def bits_for(models: int) -> int:
    """How many bits the codes may have, so that the tables of so many models stay below MOST_ROWS."""
    return max(1, min(BITS, (MOST_ROWS // max(models, 1)).bit_length() - 1))


@dataclass(frozen=True)
class Member:
    """A model of a stack: which of the labels and weights are its own, its seed, and its loss (one of nets.OBJECTIVES)."""

    label: int = 0
    weight: int = 0
    seed: int = 0
    loss: str = "bce"


def rows_to_learn(df: DataFrame, x: Column, labels: list[Column], weights: list[Column], batches: int, lists: list[str] | None = None, row_id: str = "row_id", longest: int = LONGEST, named: bool = False) -> DataFrame:
    """batch, n, x, y, w: a record for each row, or for each list of rows that are equal in ``lists``.

    Rows without any weight are left out. A list of more than ``longest`` rows is cut, by a hash of the
    row, into lists of about that many, so that no row is lost and no list grows without bound.
    named: also list, places: the least row of the list that a record was cut from, null for a whole one, and the record's rows.
    """
    y, w = (F.array(*[c.cast("float") for c in columns]) for columns in (labels, weights))
    rows = df.withColumns({"_x": x, "_y": y, "_w": w}).where(F.exists("_w", lambda v: v > 0))
    if not lists:
        return rows.select(F.pmod(F.xxhash64(row_id, F.lit(1)), F.lit(batches)).cast("int").alias("batch"), F.lit(1).alias("n"), F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_w").alias("w"))
    keys = [F.col(c).alias(f"_l{i}") for i, c in enumerate(lists)]
    rows = rows.select(*keys, F.col(row_id).alias("_r"), "_x", "_y", "_w")
    names = [f"_l{i}" for i in range(len(lists))]
    sizes = rows.groupBy(*names).agg(F.count("*").alias("_n"), F.min("_r").cast("long").alias("_first")).select(*[F.col(c).alias(f"_j{c}") for c in names], "_n", "_first")
    same = [F.col(c).eqNullSafe(F.col(f"_j{c}")) for c in names]
    cut = rows.join(sizes, same).withColumn("_part", F.pmod(F.xxhash64("_r", F.lit(2)), F.ceil(F.col("_n") / longest)))
    made = cut.groupBy(*names, "_part").agg(F.sort_array(F.collect_list(F.struct("_r", "_x", "_y", "_w"))).alias("_rows"), F.min(F.when(F.col("_n") > longest, F.col("_first"))).alias("list"))
    flat = [F.expr(f"flatten(transform(_rows, r -> r._{c})) AS {c}") for c in "xyw"]
    return made.select(F.pmod(F.xxhash64(*names, "_part", F.lit(1)), F.lit(batches)).cast("int").alias("batch"), F.size("_rows").alias("n"), *flat, *(["list", F.expr("transform(_rows, r -> CAST(r._r AS BIGINT)) AS places")] if named else []))


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def slots_of(codes: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of codes in the sorted ``codes``; -1 for others, among them -1 itself."""
    at = np.minimum(np.searchsorted(codes, x), max(len(codes) - 1, 0))
    return np.where(codes[at] == x, at, -1) if len(codes) else np.full(x.shape, -1)


def _parts(batch: pa.RecordBatch, labels: int, weights: int, times: int = 1) -> Iterator[tuple[np.ndarray, ...]]:
    """x, y, w, lengths of whole lists, about ``times`` ROWS_AT_ONCE rows together."""
    lengths = batch.column("n").to_numpy()
    if not len(lengths) or not lengths.sum():
        return
    rows = int(lengths.sum())
    x, y, w = (_flat(batch.column(c)).reshape(rows, -1) for c in ("x", "y", "w"))
    ends, at = np.cumsum(lengths), 0
    while at < len(lengths):
        low = int(ends[at] - lengths[at])
        stop = max(at + 1, int(np.searchsorted(ends, low + times * ROWS_AT_ONCE, "right")))
        high = int(ends[stop - 1])
        yield x[low:high], y[low:high].astype(np.float64), w[low:high].astype(np.float64), lengths[at:stop]
        at = stop


def _merged(held: list[tuple[np.ndarray | None, np.ndarray]]) -> tuple[np.ndarray | None, np.ndarray]:
    """The sum of gradients of one table."""
    if held[0][0] is None:
        return None, sum(v for _, v in held)
    rows, values = np.concatenate([r for r, _ in held]), np.concatenate([v for _, v in held])
    order = np.argsort(rows, kind="stable")
    rows, values = rows[order], values[order]
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    return rows[starts], np.add.reduceat(values, starts, 0) if len(starts) else values


def _used(member: Member, over: Totals) -> bool:
    return (over.weight if member.loss == "bce" else over.lists) > 0


def _partial(batches: Iterator[pa.RecordBatch], net, members: list[Member], codes: np.ndarray, params: dict[int, Params], over: dict[int, Totals]) -> dict[tuple[int, str], tuple[np.ndarray | None, np.ndarray]]:
    """Loss and gradients of the models in ``params`` over a task's records."""
    held: dict[tuple[int, str], list] = {}
    for batch in batches:
        for x, y, w, lengths in _parts(batch, 0, 0, net.more_rows):
            slots = net.seen(slots_of(codes, x))
            for i, p in params.items():
                of = w[:, members[i].weight]
                if not of.any():
                    continue
                s, kept = net.forward(p, slots)
                value, ds = objective(members[i].loss, s, y[:, members[i].label], of, lengths, over[i])
                held.setdefault((i, "loss"), []).append((None, np.array([value])))
                for name, g in net.backward(p, slots, kept, ds).items():
                    held.setdefault((i, name), []).append(g)
        held = {k: [_merged(v)] for k, v in held.items()}
    return {k: v[0] for k, v in held.items()}


_GRADIENT = "model int, name string, block int, places binary, sums binary"


def _as_batch(found: dict[tuple[int, str], tuple[np.ndarray | None, np.ndarray]]) -> pa.RecordBatch:
    out = []
    for (m, name), (rows, values) in found.items():
        if rows is None:
            out.append((m, name, -1, b"", values.astype("<f8").tobytes()))
        else:
            for b in np.unique(rows // BLOCK):
                of = rows // BLOCK == b
                out.append((m, name, int(b), rows[of].astype("<i8").tobytes(), values[of].astype("<f8").tobytes()))
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary()]
    columns = zip(*out, strict=True) if out else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["model", "name", "block", "places", "sums"])


def _from_row(places: bytes, sums: bytes, block: int) -> tuple[np.ndarray | None, np.ndarray]:
    values = np.frombuffer(sums, "<f8")
    if block < 0:
        return None, values
    rows = np.frombuffer(places, "<i8")
    return rows, values.reshape(len(rows), -1)


def _added(table: pa.Table) -> pa.Table:
    """Partial gradients of one block as one."""
    m, name, block = (table.column(c)[0].as_py() for c in ("model", "name", "block"))
    held = [_from_row(p, s, block) for p, s in zip(table.column("places").to_pylist(), table.column("sums").to_pylist(), strict=True)]
    return pa.Table.from_batches([_as_batch({(m, name): _merged(held)})])


@dataclass
class Adam:
    """Parameters with the running means of their gradients and of the squares."""

    params: Params
    rate: float
    decay: float = 0.0
    step: int = 0
    first: Params = field(default_factory=dict)
    second: Params = field(default_factory=dict)

    def move(self, gradient: Params) -> None:
        self.step += 1
        for name, p in self.params.items():
            g = gradient.get(name, np.zeros_like(p)) + self.decay * p
            m = self.first[name] = 0.9 * self.first.get(name, 0.0) + 0.1 * g
            v = self.second[name] = 0.999 * self.second.get(name, 0.0) + 0.001 * g * g
            self.params[name] = p - self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)


_HELD = "part int, model int, name string, block int, places binary, sums binary, first binary, second binary, touched binary"
_STATE = pa.schema([("part", pa.int32()), ("model", pa.int32()), ("name", pa.string()), ("block", pa.int32()), *[(c, pa.binary()) for c in ("places", "sums", "first", "second", "touched")], ("kind", pa.string())])
#: Blocks of what parts exchange: a part's tables, gradients of its codes, and, from here on down, what part 0, 1, ... lends.
OWN, TO_OWNER, LENT = -1, -2, -3


def _packed(values: np.ndarray) -> bytes:
    return values.astype("<f8").tobytes()


def _as_state(part: int, codes: np.ndarray, models: dict[int, Adam]) -> list[dict]:
    """A record for each model and table of a part. Rows without a gradient so far are as they started and take no room: users' rows of a table of items, say."""
    out = []
    for i, m in models.items():
        for n, p in m.params.items():
            touched = (m.first[n] != 0).any(1) | (m.second[n] != 0).any(1)
            out.append({"part": part, "model": i, "name": n, "block": OWN, "places": codes.astype("<i4").tobytes(), **{c: _packed(v[touched]) for c, v in (("sums", p), ("first", m.first[n]), ("second", m.second[n]))}, "touched": touched.tobytes(), "kind": "state"})
    return out


def _from_state(records: list[dict], net, members: list[Member]) -> tuple[np.ndarray, dict[int, Adam]]:
    """A part's codes, which are sorted, and its tables by model."""
    codes, models = np.zeros(0, np.int32), {}
    for r in records:
        if r["block"] == OWN:
            codes, touched = np.frombuffer(r["places"], "<i4"), np.frombuffer(r["touched"], bool)
            m, n = models.setdefault(r["model"], Adam({}, 0.0)), r["name"]
            start = net.start(codes[~touched], members[r["model"]].seed)[n]
            for of, c in ((m.params, "sums"), (m.first, "first"), (m.second, "second")):
                of[n] = np.zeros((len(codes), start.shape[1]))
                of[n][touched] = np.frombuffer(r[c], "<f8").reshape(-1, start.shape[1])
            m.params[n][~touched] = start
    return codes, models


def _from_lent(records: list[dict]) -> tuple[np.ndarray, np.ndarray, dict[int, Params]]:
    """Codes that other parts lend, the parts they come from, and their rows by model."""
    codes, homes, found = np.zeros(0, np.int32), np.zeros(0, np.int32), {}
    for r in records:
        if r["block"] <= LENT:
            found.setdefault((r["model"], r["name"]), {})[LENT - r["block"]] = (np.frombuffer(r["places"], "<i4"), np.frombuffer(r["sums"], "<f8"))
    models: dict[int, Params] = {}
    for (i, name), by_home in found.items():
        some = sorted(by_home.items())  # the same order for all tables
        codes, homes = np.concatenate([c for _, (c, _) in some]), np.repeat([h for h, _ in some], [len(c) for _, (c, _) in some])
        models.setdefault(i, {})[name] = np.concatenate([v.reshape(len(c), -1) for _, (c, v) in some])
    return codes, homes, models


def _near(own: dict[int, Adam], lent: dict[int, Params]) -> dict[int, Params]:
    """A part's own rows and below them those lent to it, by model and table."""
    tables = ({i: m.params for i, m in own.items()}, lent)
    out: dict[int, Params] = {}
    for model in {*own, *lent}:
        some = [t[model] for t in tables if model in t]
        out[model] = {n: np.concatenate([t[n] for t in some]) for n in some[0]}
    return out


def _joined(tables: tuple[str, ...], local: np.ndarray, own: dict[int, Params], shared: np.ndarray, models: dict[int, Params]) -> tuple[np.ndarray, np.ndarray, dict[int, Params]]:
    """Codes of a part and the shared ones in their order, their places in (part, shared), and the models over them."""
    codes, at = np.unique(np.concatenate([local, shared]), return_index=True)
    return codes, at, {i: {n: np.concatenate([own[i][n], v])[at] if n in tables and i in own else v[at - len(local)] if n in tables else v for n, v in p.items()} for i, p in models.items()}


@dataclass
class Parts:
    """Tables of embeddings that lie with the rows, for stacks whose gradients are too many for the driver.

    Records are dealt into parts by the code that leads them, the first field's; each code has its home in
    the part that it would lead to. The driver holds the codes that most records name beside their
    leading one, as many as SHARED_BYTES allows, and leading ones of more than a part's share of the rows, whose records
    are dealt by chance; it gets their gradients summed. All other rows of tables are moved at home. Where records
    name codes that are at home in another part, that part lends their rows and gets their gradients.
    A step is a cogroup of a batch with its parts' tables, written to one of two folders in turn.
    """

    net: object
    members: list[Member]
    count: int
    hot: list[int]
    shared: np.ndarray
    known: DataFrame
    folders: tuple[str, str]
    bests: tuple[str, str]
    now: DataFrame
    needs: DataFrame | None = None
    best: DataFrame | None = None
    turn: int = 0
    turn_best: int = 0
    asked: dict[int, tuple[DataFrame, DataFrame | None]] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: DataFrame, stack: Stack, bytes_of_code: int) -> Parts:
        """bytes_of_code: what a code's gradients of all steps take."""
        spark, lead = rows.sparkSession, F.col("x")[0]
        total = rows.agg(F.sum("n")).first()[0]
        count = max(4 * spark.sparkContext.defaultParallelism, -(-total // ROWS_OF_PART))
        hot = [r.c for r in rows.groupBy(lead.alias("c")).agg(F.sum("n").alias("n")).where(F.col("n") > total / count).collect()]  # fewer than there are parts
        others = rows.select(F.explode(F.array_except("x", F.array(lead))).alias("c")).where("c >= 0").groupBy("c").count()
        often = others.orderBy(F.desc("count"), "c").limit(SHARED_BYTES // bytes_of_code).toArrow().column("c").to_numpy()
        shared = np.unique(np.concatenate([often, np.array([h for h in hot if h >= 0], often.dtype)]))
        known = stored(rows.select(F.explode(F.array_distinct("x")).alias("c")).where("c >= 0").distinct(), "codes")
        out = cls(stack.net, stack.members, count, hot, shared, known, *((scratch(spark, f"{n}-a"), scratch(spark, f"{n}-b")) for n in ("tables", "best")), None)
        net, members = stack.net, stack.members

        def started(key: tuple, table: pa.Table) -> pa.Table:
            codes = np.setdiff1d(table.column("c").to_numpy(), shared).astype(np.int32)
            models = {}
            for i, m in enumerate(members):
                p = {n: v for n, v in net.start(codes, m.seed).items() if n in net.tables}
                models[i] = Adam(p, 0.0, first={n: np.zeros_like(v) for n, v in p.items()}, second={n: np.zeros_like(v) for n, v in p.items()})
            return pa.Table.from_pylist(_as_state(key[0].as_py(), codes, models) if len(codes) else [], _STATE)

        out._write(known.withColumn("part", out.home(F.col("c"))).groupBy("part").applyInArrow(started, f"{_HELD}, kind string"))
        out.needs = out._needs(rows, ["batch"])
        return out

    def home(self, c: Column) -> Column:
        """The part of a code that isn't shared."""
        return F.pmod(F.xxhash64(c), F.lit(self.count)).cast("int")

    def number(self, x: str) -> Column:
        """The part of a record."""
        lead = F.col(x)[0]
        return F.when(lead.isin(self.hot), F.pmod(F.xxhash64(x), F.lit(self.count)).cast("int")).otherwise(self.home(lead)) if self.hot else self.home(lead)

    def _needs(self, df: DataFrame, by: list[str]) -> DataFrame | None:
        """home, part, codes, for each of ``by``: what records of a part name of the codes of another; None if that is nothing."""
        shared = df.sparkSession.createDataFrame([(int(c),) for c in self.shared], "c int")
        named = df.select(*by, self.number("x").alias("part"), F.explode(F.array_distinct("x")).alias("c")).where("c >= 0").withColumn("home", self.home(F.col("c")))
        named = named.where("home <> part").join(F.broadcast(shared), "c", "left_anti").distinct().join(self.known, "c", "left_semi")
        out = stored(named.groupBy(*by, "home", "part").agg(F.collect_list("c").alias("codes")), "needs", by)
        return None if out.isEmpty() else out

    def _tables(self, needs: DataFrame | None) -> DataFrame:
        """The tables of parts, and what other parts lend them."""
        if needs is None:
            return self.now
        net, members = self.net, self.members

        def lent(key: tuple, asked: pa.Table, state: pa.Table) -> pa.Table:
            wanted = [(p, np.array(c, np.int32)) for p, c in zip(asked.column("part").to_pylist(), asked.column("codes").to_pylist(), strict=True)]
            out, (codes, models) = [], _from_state(state.to_pylist(), net, members)
            for part, c in wanted:
                at = slots_of(codes, c)
                at = at[at >= 0]
                if len(at):
                    out += [{"part": part, "model": i, "name": n, "block": LENT - key[0].as_py(), "places": codes[at].tobytes(), "sums": _packed(v[at])} for i, m in models.items() for n, v in m.params.items()]
            return pa.Table.from_pylist(out, _STATE.remove(_STATE.get_field_index("kind")))

        here = self.now.drop("kind")
        return here.unionByName(needs.groupBy("home").cogroup(here.groupBy("part")).applyInArrow(lent, _HELD))

    def _write(self, held: DataFrame) -> DataFrame:
        """Puts what a step made into the folder whose turn it is; gives its gradients."""
        path, self.turn = self.folders[self.turn], 1 - self.turn
        held.write.mode("overwrite").partitionBy("kind").parquet(path)
        found = held.sparkSession.read.schema(f"{_HELD}, kind string").parquet(path)
        self.now = found.where("kind = 'state'")
        return found.where("kind = 'grad'").select("model", "name", "block", "places", "sums")

    def step(self, stack: Stack, batch: DataFrame, over: dict[int, Totals], number: int) -> tuple[list[float], list[Params]]:
        """Moves the parts' own codes by the records of batch ``number``; loss, and gradient of what the driver holds."""
        net, members, shared = stack.net, stack.members, self.shared
        over = {i: t for i, t in over.items() if _used(members[i], t)}
        params = {i: stack.models[i].params for i in over}
        steps, rate, decay = {i: stack.models[i].step for i in over}, stack.rate, stack.decay

        def summed(part: int, records: pa.Table, state: list[dict]) -> tuple[list[dict], list[dict]]:
            """Gradients for the driver, and those of codes that are at home in this part and in others."""
            (local, own), (lent, homes, rows) = _from_state(state, net, members), _from_lent(state)
            near = np.concatenate([local, lent])
            codes, at, joined = _joined(net.tables, near, _near(own, rows), shared, params)
            owner, driver, owners = np.concatenate([np.full(len(local), part), homes]), {}, []
            for (i, name), (slots, values) in _partial(records.combine_chunks().to_batches(), net, members, codes, joined, over).items():
                if slots is None:
                    driver[i, name] = (None, values)
                    continue
                place = at[slots]
                here = place < len(near)
                if not here.all():
                    driver[i, name] = (place[~here] - len(near), values[~here])
                place, values = place[here], values[here]
                for h in np.unique(owner[place]):
                    of = owner[place] == h
                    owners.append({"part": int(h), "model": i, "name": name, "block": TO_OWNER, "places": near[place[of]].astype("<i4").tobytes(), "sums": _packed(values[of])})
            return [r | {"part": part} for r in _as_batch(driver).to_pylist()], owners

        def moved(part: int, gradients: list[dict], state: list[dict]) -> list[dict]:
            """The part's tables after the step."""
            local, own = _from_state(state, net, members)
            mine: dict[int, Params] = {i: {n: np.zeros_like(p) for n, p in m.params.items()} for i, m in own.items() if i in over}
            for r in gradients:
                codes = np.frombuffer(r["places"], "<i4")
                mine[r["model"]][r["name"]][np.searchsorted(local, codes)] += np.frombuffer(r["sums"], "<f8").reshape(len(codes), -1)
            for i, g in mine.items():
                own[i].rate, own[i].decay, own[i].step = rate, decay, steps[i]
                own[i].move(g)
            return _as_state(part, local, own)

        def at_once(key: tuple, records: pa.Table, state: pa.Table) -> pa.Table:
            part, held = key[0].as_py(), state.to_pylist()
            driver, owners = summed(part, records, held)
            return pa.Table.from_pylist(moved(part, owners, held) + [r | {"kind": "grad"} for r in driver], _STATE)

        def made(key: tuple, records: pa.Table, state: pa.Table) -> pa.Table:
            driver, owners = summed(key[0].as_py(), records, state.to_pylist())
            return pa.Table.from_pylist(driver + owners, _STATE.remove(_STATE.get_field_index("kind")))

        def taken(key: tuple, gradients: pa.Table, state: pa.Table) -> pa.Table:
            found = gradients.to_pylist()
            return pa.Table.from_pylist(moved(key[0].as_py(), [r for r in found if r["block"] == TO_OWNER], state.to_pylist()) + [r | {"kind": "grad"} for r in found if r["block"] != TO_OWNER], _STATE)

        records, kinds = batch.select("n", "x", "y", "w", self.number("x").alias("part")).groupBy("part"), f"{_HELD}, kind string"
        if self.needs is None:
            held = records.cogroup(self.now.groupBy("part")).applyInArrow(at_once, kinds)
        else:
            tables = self._tables(self.needs.where(F.col("batch") == number))
            gradients = records.cogroup(tables.groupBy("part")).applyInArrow(made, _HELD)
            held = gradients.groupBy("part").cogroup(self.now.groupBy("part")).applyInArrow(taken, kinds)
        parts = self._write(held).groupBy("model", "name", "block").applyInArrow(_added, _GRADIENT)
        return stack._gathered(parts, params)

    def keep(self, better: set[int]) -> None:
        """Makes the tables of these models their best so far."""
        if better:
            now, path = self.now.where(F.col("model").isin(*better)), self.bests[self.turn_best]
            self.turn_best = 1 - self.turn_best
            (now if self.best is None else now.unionByName(self.best.where(~F.col("model").isin(*better)))).write.mode("overwrite").parquet(path)
            self.best = now.sparkSession.read.schema(f"{_HELD}, kind string").parquet(path)

    def back(self, models: set[int]) -> None:
        """Makes the best tables of these models the ones that score."""
        if self.best is not None:
            rest = self.now.where(~F.col("model").isin(*models))
            self.now = self.best.where(F.col("model").isin(*models)).unionByName(rest)

    def scored(self, stack: Stack, df: DataFrame, source: DataFrame, scored: Callable, kinds: str) -> DataFrame:
        if id(df) not in self.asked:
            self.asked[id(df)] = (df, self._needs(df, []))
        net, members, shared, models = stack.net, stack.members, self.shared, dict(enumerate(m.params for m in stack.models))

        def of_part(rows: pa.Table, state: pa.Table) -> pa.Table:
            held = state.to_pylist()
            (local, own), (lent, _, borrowed) = _from_state(held, net, members), _from_lent(held)
            codes, _, joined = _joined(net.tables, np.concatenate([local, lent]), _near(own, borrowed), shared, models)
            out = list(scored(rows.drop_columns(["part"]).combine_chunks().to_batches(), codes, [joined[i] for i in range(len(models))]))
            return pa.Table.from_batches(out) if out else empty

        columns = to_arrow_schema(StructType([f for f in source.schema if f.name.startswith("k")]))
        empty = pa.schema([*columns, ("score", pa.list_(pa.float64()))]).empty_table()
        return source.groupBy("part").cogroup(self._tables(self.asked[id(df)][1]).groupBy("part")).applyInArrow(of_part, kinds)


@dataclass
class Stack:
    """Models of one kind that are fitted side by side."""

    net: object
    members: list[Member]
    rate: float = 0.02
    decay: float = 1e-6
    bits: int = BITS
    codes: np.ndarray | None = None
    tasks: int = 0
    models: list[Adam] = field(default_factory=list)
    curves: list[list[float]] = field(default_factory=list)
    best: list[int] = field(default_factory=list)
    fan_in: int = FAN_IN
    parts: Parts | None = None
    scored: str = ""

    def begin(self, rows: DataFrame, steps: int = 1) -> dict[tuple[int, int], Totals]:
        """Starts the models; of each batch and model what its losses are divided by. The driver gets the codes that occur, of which there are 2**bits at most; where ``steps`` would send it too much of their gradients, it keeps those that Parts shares."""
        self.tasks = rows.rdd.getNumPartitions()  # a batch has no more
        found = rows.select(F.explode(F.array_distinct("x")).alias("c")).distinct().where("c >= 0").toArrow().column("c").to_numpy()
        self.codes = np.sort(found)
        one = self.net.start(self.codes[:1], 0)
        of_code = len(self.members) * steps * sum(8 * one[t].shape[-1] + 8 for t in self.net.tables)
        bytes_ = len(self.codes) * of_code + len(self.members) * steps * sum(8 * v.size for n, v in one.items() if n not in self.net.tables)
        self.fan_in = FAN_IN if min(self.tasks, FAN_IN) * bytes_ <= DRIVER_BYTES else 1
        if bytes_ > DRIVER_BYTES:
            self.parts = Parts.of(rows, self, of_code)
            self.codes = self.parts.shared
        self.models = [Adam(self.net.start(self.codes, m.seed), self.rate, self.decay) for m in self.members]
        self.curves, self.best = [[] for _ in self.members], [0 for _ in self.members]
        members = self.members

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                numbers = batch.column("batch").to_numpy()
                for b in np.unique(numbers):
                    for _, y, w, lengths in _parts(batch.filter(pa.array(numbers == b)), 0, 0):
                        for i, m in enumerate(members):
                            t = totals(y[:, m.label], w[:, m.weight], lengths)
                            sums[int(b), i] = sums.get((int(b), i), 0) + np.array([t.weight, t.lists, t.positives])
            columns = [[b for b, _ in sums], [i for _, i in sums], *([float(v[j]) for v in sums.values()] for j in range(3))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), *[pa.float64()] * 3), strict=True)], names=["batch", "model", "weight", "lists", "positives"])

        parts = rows.mapInArrow(counted, "batch int, model int, weight double, lists double, positives double")
        each = parts.groupBy("batch", "model").agg(*[F.sum(c).alias(c) for c in ("weight", "lists", "positives")]).collect()
        return {(r.batch, r.model): Totals(r.weight, r.lists, r.positives) for r in each}

    def gradients(self, rows: DataFrame, over: dict[int, Totals]) -> tuple[list[float], list[Params]]:
        """Loss and gradient of each model over ``rows``; empty ones for models that aren't in ``over``."""
        net, codes, members = self.net, self.codes, self.members
        params = {i: self.models[i].params for i in over if _used(members[i], over[i])}

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield _as_batch(_partial(batches, net, members, codes, params, over))

        parts = rows.select("n", "x", "y", "w").mapInArrow(partial, _GRADIENT)
        if self.tasks > self.fan_in:
            parts = parts.groupBy("model", "name", "block").applyInArrow(_added, _GRADIENT)
        return self._gathered(parts, params)

    def _gathered(self, parts: DataFrame, params: dict[int, Params]) -> tuple[list[float], list[Params]]:
        losses, out = [0.0] * len(self.members), [{} for _ in self.members]
        for r in parts.toArrow().to_pylist():
            rows_, values = _from_row(r["places"], r["sums"], r["block"])
            i, name = r["model"], r["name"]
            if name == "loss":
                losses[i] += float(values[0])
                continue
            p = params[i][name]
            g = out[i].setdefault(name, np.zeros_like(p))
            if rows_ is None:
                g += values.reshape(p.shape)
            else:
                g[rows_] += values
        return losses, out

    def fit(self, rows: DataFrame, batches: int, epochs: int, valid: Callable[[Stack], list[float]] | None = None, patience: int = 4, least: float = 1e-5, seed: int = 0) -> Stack:
        """Passes over ``rows`` (of rows_to_learn(), stored by batch) in a new order of batches each time.

        With ``valid``, which gives each model's primary, a model stops after ``patience`` passes without
        gain and is as it was after its best one; the others go on.
        """
        over = self.begin(rows, batches * epochs)
        rng, going, state = np.random.default_rng(seed), set(range(len(self.members))), {}
        for epoch in range(1, epochs + 1):
            for b in rng.permutation(batches).tolist():
                now = {i: over[b, i] for i in going if (b, i) in over}
                if not now:
                    continue
                batch = rows.where(F.col("batch") == b)
                for i, g in enumerate((self.parts.step(self, batch, now, b) if self.parts else self.gradients(batch, now))[1]):
                    if g:
                        self.models[i].move(g)
            if valid is None:
                self.best = [epoch] * len(self.members)
                continue
            better = set()
            for i, primary in enumerate(valid(self)):
                if i in going:
                    curve = self.curves[i]
                    curve.append(primary)
                    if primary > max(curve[:-1], default=-1.0) + least:
                        self.best[i], state[i] = epoch, {n: p.copy() for n, p in self.models[i].params.items()}
                        better.add(i)
                    elif epoch - self.best[i] >= patience:
                        going.discard(i)
            if self.parts:
                self.parts.keep(better)
            if not going:
                break
        for i, p in state.items():
            self.models[i].params = p
        if self.parts:
            self.parts.back(set(state))
        return self

    def scores(self, df: DataFrame, keep: list[str], of_window: str | None = None, per_window: int = 1) -> DataFrame:
        """Columns ``keep`` and score: an array with each model's score of a row that has slots ``x``.

        of_window: a column with the number of the row's window; then only the ``per_window`` models from
        that number times ``per_window`` on are asked, none for a negative or null one.
        """
        net, codes, models = self.net, self.codes, [m.params for m in self.models]
        parts = [self.parts.number("x").alias("part")] if self.parts else []
        source = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], "x", *parts, F.coalesce(F.col(of_window), F.lit(-1)).cast("int").alias("win") if of_window else F.lit(0).alias("win"))
        count = per_window if of_window else len(models)

        def scored(batches: Iterator[pa.RecordBatch], codes: np.ndarray = codes, models: list[Params] = models) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                x, win, out = slots_of(codes, _flat(batch.column("x")).reshape(n, -1)), batch.column("win").to_numpy(), np.zeros((n, count))
                for v in np.unique(win[win >= 0]):
                    rows = np.flatnonzero(win == v)
                    for at in range(0, len(rows), net.more_rows * ROWS_AT_ONCE):
                        some = rows[at : at + net.more_rows * ROWS_AT_ONCE]
                        slots = net.seen(x[some])
                        for j in range(count):
                            out[some, j] = net.forward(models[v * per_window + j if of_window else j], slots)[0]
                listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * count, pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], listed], names=[*batch.schema.names[: len(keep)], "score"])

        kinds = ", ".join([*[f"k{i} {source.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))], "score array<double>"])
        out = self.parts.scored(self, df, source, scored, kinds) if self.parts else source.mapInArrow(lambda batches: scored(batches), kinds)
        return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "score")

    def primaries(self, valid: DataFrame, label: str, group: str = "user_id", row_id: str = "row_id") -> list[float]:
        """Each model's primary over rows with slots ``x``, all by one evaluation; 0 for one without rows."""
        self.scored = self.scored or scratch(valid.sparkSession, "scored")
        scores = self.scores(valid, [row_id, group, label])
        scores.write.mode("overwrite").parquet(self.scored)  # metrics read them twice
        rows = valid.sparkSession.read.schema(scores.schema).parquet(self.scored).select(row_id, group, label, F.posexplode("score").alias("model", "score"))
        got = {r.model: r.primary for r in metrics.evaluate(rows, label, "score", [group], row_id, by=["model"]).collect()}
        return [got.get(i, 0.0) for i in range(len(self.members))]

"""Donor matching of predictive mean matching, in one range exchange (M5).

Rows are ordered by their prediction: a range exchange on (set, prediction,
hash of the id) gives every task a stretch of that order, and a constant
prediction spreads over tasks by the hash.  A task looks its recipients' k
nearest donors up among its own.  Where the kth is nearer than both ends of the
stretch no other task has a nearer one; the few recipients beside an end keep
their own k donors and are settled against the outermost donors of the other
stretches (at most k for each distinct prediction and side), so the k nearest
are exact whatever lies beside the stretch.  No row is joined to any other.
Rows that only give values (``donors``) travel as prediction, id and value.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrition.functions.exprs import hex_digits_value, md5_key
from attrition.session import batches_by_rows, materialize, python_workers


def ranks(ids: pd.Series) -> np.ndarray:
    """Places of the ids in their order, equal ones by position, nulls first."""
    by = np.argsort(ids.to_numpy(), kind="stable") if ids.dtype == np.int64 else ids.argsort(kind="stable").to_numpy()
    out = np.empty(len(ids), np.int64)
    if ids.dtype == np.int64:
        out[by] = np.arange(len(ids))
        return out
    return np.nan_to_num(ids.rank(method="first").to_numpy(float), nan=-1.0).astype(np.int64)


def order_of(donors: pd.DataFrame, k: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Donors in the order in which a recipient meets them above and below
    itself: by prediction upwards and downwards, equal ones by id; of equal
    predictions only the first k can ever be met."""
    if donors["id"].dtype == np.int64:
        up = donors.iloc[np.lexsort((donors["id"].to_numpy(), donors["yhat"].to_numpy()))]
    else:
        up = donors.sort_values(["yhat", "id"], kind="stable")
    y, at = up["yhat"].to_numpy(), np.arange(len(up))
    first = np.maximum.accumulate(np.where(np.concatenate([[True], y[1:] != y[:-1]]), at, 0)) if len(up) else at
    up = up[at - first < k]
    down = up.iloc[np.argsort(-up["yhat"].to_numpy(), kind="stable")]
    return up.reset_index(drop=True), down.reset_index(drop=True)


def nearest(recipients: np.ndarray, up: pd.DataFrame, down: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each recipient's prediction the rows of ``up`` of its k nearest
    donors (distance, then id), and how many there are."""
    n = len(up)
    if not n:
        return np.zeros((len(recipients), k), np.int64), np.zeros(len(recipients), np.int64)
    values = up["yhat"].to_numpy()
    rank = ranks(up["id"])
    # rows of `up` in the order of `down`
    back = np.argsort(-values, kind="stable")
    at = np.searchsorted(values, recipients, side="left")
    step = np.arange(k)
    above = at[:, None] + step
    below = (n - at)[:, None] + step
    row = np.concatenate([np.minimum(above, n - 1), back[np.minimum(below, n - 1)]], axis=1)
    gone = np.concatenate([above >= n, below >= n], axis=1)
    far = np.where(gone, np.inf, np.abs(recipients[:, None] - values[row]))
    by_id = np.argsort(np.where(gone, np.iinfo(np.int64).max, rank[row]), axis=1, kind="stable")
    far, row = np.take_along_axis(far, by_id, 1), np.take_along_axis(row, by_id, 1)
    first = np.argsort(far, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(row, first, 1), np.minimum(k, (~gone).sum(axis=1))


def lists(lengths: np.ndarray, items: dict[str, pa.Array]) -> pa.Array:
    """A list of structs for each length, from the items in that order."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([*items.values()], names=[*items]))


#: What a task returns: answered recipients and known rows, recipients beside an end, the stretch's outermost donors.
DONE, OPEN, EDGE = 0, 1, 2


def matched(rows: DataFrame, id_col: str, value_cols: Sequence[str], k: int, pick: Column, out: Sequence[str],
            set_col: str | None = None, donors: DataFrame | None = None) -> DataFrame:
    """All rows with ``out`` columns: a recipient's are the ``value_cols`` of
    one of its k nearest donors, a donor's its own.  ``rows`` has ``__yhat``,
    ``__donor`` (boolean) and any other columns, which pass through;
    ``pick`` is a whole number that chooses among the donors.  Without any
    donor, or without a prediction, a recipient's values are null.  ``donors``
    (set, ``__yhat``, id and values) give values and are not returned.  The rows
    are written to the shared checkpoint folder."""
    spark = python_workers(rows.sparkSession)
    values, keep = list(value_cols), [c for c in rows.columns if c not in ("__yhat", "__donor")]
    types = dict(rows.dtypes)
    row_type = f"array<struct<{','.join(f'c{i}:{types[c]}' for i, c in enumerate(keep))}>>"

    def narrow(df: DataFrame, donor: Column, picked: Column, row: Column) -> DataFrame:
        return df.select((F.col(set_col).cast("int") if set_col else F.lit(0)).alias("set"), F.col("__yhat").cast("double").alias("yhat"),
                         F.xxhash64(id_col).alias("spread"), donor.alias("donor"), F.col(f"`{id_col}`").alias("id"), picked.alias("pick"),
                         *[F.col(f"`{v}`").cast(types[v]).alias(f"v{i}") for i, v in enumerate(values)], row.cast(row_type).alias("row"))

    d = narrow(rows, F.col("__donor"), pick.cast("long"), F.array(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])))
    if donors is not None:
        # an empty array: a null one costs Arrow a look at all nulls before it, row by row
        d = d.unionByName(narrow(donors, F.lit(True), F.lit(None).cast("long"), F.array()))
    d = d.repartitionByRange("set", "yhat", "spread").drop("spread")
    names = [f"v{i}" for i in range(len(values))]
    met = ", ".join(f"{n}: {t}" for n, t in [("yhat", "double"), ("id", types[id_col]), *[(n, types[v]) for n, v in zip(names, values)]])
    schema = ", ".join(["kind int, part int, set int, yhat double, pick long", f"row {row_type}", f"met array<struct<{met}>>",
                        *[f"{n} {types[v]}" for n, v in zip(names, values)]])

    def look(batches):
        """Answers from the task's own stretch."""
        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        table = pa.table({c: pa.concat_arrays(table[c].chunks) for c in table.column_names})
        yhat = table["yhat"].to_pandas().to_numpy(float)
        frame = pd.DataFrame({"set": table["set"].to_numpy(), "yhat": yhat, "id": table["id"].to_pandas(), "place": np.arange(len(table)),
                              "donor": table["donor"].to_pandas().to_numpy(bool) & ~np.isnan(yhat)})
        part = TaskContext.get().partitionId()
        picks = table["pick"].to_pandas().fillna(0).to_numpy(np.int64)
        take = np.where(frame["donor"], frame["place"], -1)
        kind = np.full(len(table), DONE, np.int32)
        open_at, open_met, edges = [], [], []
        for s, some in frame.groupby("set"):
            up, down = order_of(some.loc[some["donor"], ["yhat", "id", "place"]], k)
            place = up["place"].to_numpy()
            edges.append((int(s), np.union1d(place[:k], down["place"].to_numpy()[:k])))
            ask = some[~some["donor"] & some["yhat"].notna()]
            if not len(ask):
                continue
            at, y = ask["place"].to_numpy(), ask["yhat"].to_numpy()
            near, count = nearest(y, up, down, k)
            last = near[np.arange(len(at)), k - 1]
            far = np.where(count == k, np.abs(y - up["yhat"].to_numpy()[last]) if len(up) else np.inf, np.inf)
            # equal distances beyond an end may go to a smaller id
            ok = far < np.minimum(y - some["yhat"].min(), some["yhat"].max() - y)
            take[at[ok]] = place[near[ok][np.arange(ok.sum()), picks[at[ok]] % k]] if ok.any() else 0
            kind[at[~ok]] = OPEN
            open_at.append(at[~ok])
            open_met += [place[n[:c]] for n, c in zip(near[~ok], count[~ok])]

        def answer(kinds, sets, at, met, source):
            """Rows of the input at the places (None: none), with what they met."""
            n = len(met)
            rows_ = table["row"].chunk(0).take(pa.array(at)) if at is not None else pa.nulls(n, table["row"].type)
            every = np.concatenate([np.zeros(0, np.int64), *met])
            items = {c: table[c].chunk(0).take(pa.array(every)) for c in ("yhat", "id", *names)}
            got = [table[c].chunk(0).take(pa.array(source, mask=source < 0)) for c in names]
            return pa.table([pa.array(np.full(n, kinds, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(sets, pa.int32()),
                             table["yhat"].chunk(0).take(pa.array(at)) if at is not None else pa.nulls(n, pa.float64()),
                             table["pick"].chunk(0).take(pa.array(at)) if at is not None else pa.nulls(n, pa.int64()), rows_,
                             lists(np.array([len(m) for m in met], np.int64), items), *got],
                            names=["kind", "part", "set", "yhat", "pick", "row", "met", *names])

        given = np.flatnonzero(pa.compute.list_value_length(table["row"].chunk(0)).to_numpy(zero_copy_only=False) > 0)
        done = given[kind[given] == DONE]
        sets = frame["set"].to_numpy()
        nothing = np.zeros(0, np.int64)
        yield from answer(DONE, sets[done], done, [nothing] * len(done), take[done]).to_batches()
        at = np.concatenate([nothing, *open_at])
        if len(at):
            yield from answer(OPEN, sets[at], at, open_met, np.full(len(at), -1)).to_batches()
        edges = [(s, at) for s, at in edges if len(at)]
        if edges:
            yield from answer(EDGE, [s for s, _ in edges], None, [at for _, at in edges], np.full(len(edges), -1)).to_batches()

    with batches_by_rows(spark):
        looked = materialize(d.mapInArrow(look, schema), "looked")
    # at most 2k donors for each task and set
    outer = looked.where(F.col("kind") == EDGE).select("part", "set", F.inline("met")).toArrow()
    told = spark.sparkContext.broadcast(outer)

    def settle(batches):
        """Answers of the open rows, from the donors that they met and the other stretches' outermost ones."""
        others = told.value.select(["part", "set", "yhat", "id"]).to_pandas()
        others["place"] = np.arange(len(others))
        for b in batches:
            if not b.num_rows:
                continue
            asked = pd.DataFrame({"part": b.column("part").to_numpy(), "set": b.column("set").to_numpy(), "yhat": b.column("yhat").to_numpy()})
            met = b.column("met")
            own = met.flatten()
            ends = np.cumsum(pa.compute.list_value_length(met).to_numpy())
            of = np.repeat(np.arange(b.num_rows), np.diff(np.concatenate([[0], ends])))
            # (row asked, distance, donor), the batch's own donors after the broadcast ones
            pairs = [pd.DataFrame({"row": of, "yhat": own.field("yhat").to_numpy(zero_copy_only=False),
                                   "id": own.field("id").to_pandas(), "place": len(others) + np.arange(len(of))})]
            for (p, s), some in asked.groupby(["part", "set"]):
                up, down = order_of(others.loc[(others["part"] != p) & (others["set"] == s), ["yhat", "id", "place"]], k)
                near, count = nearest(some["yhat"].to_numpy(), up, down, k)
                there = np.arange(k) < count[:, None]
                pairs.append(up.iloc[near[there]].assign(row=np.repeat(some.index.to_numpy(), count)))
            pairs = pd.concat([p for p in pairs if len(p)] or pairs[:1], ignore_index=True)
            pairs["far"] = np.abs(pairs["yhat"].to_numpy() - asked["yhat"].to_numpy()[pairs["row"]])
            pairs["rank"] = ranks(pairs["id"])
            pairs = pairs.iloc[np.lexsort((pairs["rank"], pairs["far"], pairs["row"]))]
            row = pairs["row"].to_numpy()
            start = np.searchsorted(row, np.arange(b.num_rows), side="left")
            count = np.minimum(k, np.searchsorted(row, np.arange(b.num_rows), side="right") - start)
            take = np.full(b.num_rows, -1)
            ok = count > 0
            take[ok] = pairs["place"].to_numpy()[start[ok] + b.column("pick").to_numpy()[ok] % count[ok]]
            index = pa.array(take, mask=take < 0)
            got = [pa.concat_arrays([*told.value[n].cast(own.field(n).type).chunks, own.field(n)]).take(index) for n in names]
            yield pa.RecordBatch.from_arrays([b.column("row"), *got], names=["row", *names])

    answers = materialize(looked.where(F.col("kind") == OPEN).mapInArrow(
        settle, ", ".join([f"row {row_type}", *[f"{n} {types[v]}" for n, v in zip(names, values)]])), "settled")
    told.destroy()
    whole = looked.where(F.col("kind") == DONE).select("row", *names).unionByName(answers)
    row = F.element_at("row", 1)
    return whole.select(*[row.getField(f"c{i}").alias(c) for i, c in enumerate(keep) if c not in out],
                        *[F.col(n).alias(o) for n, o in zip(names, out)])


def hashed_pick(id_col: str, seed: str) -> Column:
    """The number that chooses a recipient's donor: from ``md5(id:seed)``."""
    return hex_digits_value(md5_key(F.col(id_col), F.lit(":"), F.lit(seed)), 1, 4)

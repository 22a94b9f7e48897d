"""Queries of factor expressions, the feature catalog, labels, baselines and candidate search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions import factors as X
from ..operators import baselines as E
from ..operators import bitemporal as B
from ..operators import labels as L
from ..operators import search as S
from . import views as V
from .folders import written
from .registry import query
from .views import sql

CLOSE, VOLUME = X.field("close"), X.field("volume")
W = "OVER (PARTITION BY instrument_id ORDER BY vt)"


def frame(w: int) -> str:
    return f"OVER (PARTITION BY instrument_id ORDER BY vt ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def _eval(spark, sf, factor, bars=V.bars, status=False):
    out = X.evaluate(bars(spark, sf), {"v": factor}, status=status)
    cols = ["instrument_id", "vt", F.round("v", 6).alias("v")] + (["v_status"] if status else [])
    return out.select(*cols)


def rolling_sql(value: str, w: int = 5, table: str = "bars", count: str = "close") -> str:
    return sql(f"SELECT instrument_id, vt, round(CASE WHEN n >= {w} THEN {value} END, 6) AS v FROM (SELECT *, count({count}) {frame(w)} AS n, row_number() {W} AS t FROM {table}) QUALIFY true", table)


@query(sql("SELECT instrument_id, vt, round(close, 6) AS v, 'ok' AS v_status FROM bars", "bars"))
def f2_field(spark, sf):
    return _eval(spark, sf, CLOSE, status=True)


@query(sql("SELECT o_orderkey, round(revenue, 4) AS v, CASE WHEN revenue IS NULL THEN 'missing_field' ELSE 'ok' END AS v_status FROM (SELECT o.o_orderkey, f.revenue, f.vt, f.revision FROM (SELECT o_orderkey, o_custkey AS instrument_id, o_orderdate::DATE AS vt FROM orders) o LEFT JOIN fundamentals f ON f.instrument_id = o.instrument_id AND f.vt <= o.vt AND f.kt <= o.vt QUALIFY row_number() OVER (PARTITION BY o.o_orderkey ORDER BY f.vt DESC NULLS LAST, f.revision DESC) = 1)", "fundamentals"))
def f3_fundamental(spark, sf):
    """The revenue that was known at each order, declared to be known after 45 days as it is."""
    left = V.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("instrument_id"), F.to_date("o_orderdate").alias("vt"))
    rows = B.known_join(left, V.fundamentals(spark, sf), "instrument_id", "revenue")
    return X.evaluate(rows, {"v": X.fundamental("revenue", 45)}).select("o_orderkey", F.round("v", 4).alias("v"), "v_status")


@query(sql("SELECT instrument_id, vt, 2.5::DOUBLE AS v, NULL::DOUBLE AS gone, 'missing_field' AS gone_status FROM bars", "bars"))
def f1_const_and_missing(spark, sf):
    out = X.evaluate(V.bars(spark, sf), {"v": X.const(2.5), "gone": X.field("nothing")})
    return out.select("instrument_id", "vt", "v", "gone", "gone_status")


@query(sql("SELECT instrument_id, vt, round(-close, 6) AS neg, round(abs(close - 50), 6) AS abs, round(CASE WHEN close > 50 THEN ln(close - 50) END, 6) AS log, sign(close - 50)::DOUBLE AS sign, CASE WHEN close > 50 THEN 'ok' ELSE 'domain_error' END AS log_status FROM bars", "bars"))
def f4_unary(spark, sf):
    d = X.binary("sub", CLOSE, X.const(50))
    out = X.evaluate(V.bars(spark, sf), {"neg": X.unary("neg", CLOSE), "abs": X.unary("abs", d), "log": X.unary("log", d), "sign": X.unary("sign", d)})
    return out.select("instrument_id", "vt", F.round("neg", 6).alias("neg"), F.round("abs", 6).alias("abs"), F.round("log", 6).alias("log"), "sign", "log_status")


@query(
    sql(
        """SELECT instrument_id, vt, round(close + open, 6) AS add, round(close - open, 6) AS sub, round(close * open, 6) AS mul, round(CASE WHEN close <> open THEN close / (close - open) END, 6) AS div,
CASE WHEN close <> open THEN 'ok' ELSE 'division_by_zero' END AS div_status, round(sign(close - open) * pow(abs(close - open), 2), 6) AS signed_power, least(close, open) AS min, greatest(close, open) AS max,
(close > open)::INT::DOUBLE AS gt, (close < open)::INT::DOUBLE AS lt FROM bars""",
        "bars",
    )
)
def f5_binary(spark, sf):
    o = X.field("open")
    d = X.binary("sub", CLOSE, o)
    named = {op: X.binary(op, CLOSE, o) for op in ("add", "sub", "mul", "min", "max", "gt", "lt")}
    named |= {"div": X.binary("div", CLOSE, d), "signed_power": X.binary("signed_power", d, X.const(2))}
    out = X.evaluate(V.bars(spark, sf), named)
    r = [F.round(n, 6).alias(n) for n in ("add", "sub", "mul", "div", "signed_power")]
    return out.select("instrument_id", "vt", *r, "div_status", "min", "max", "gt", "lt")


@query(sql(f"SELECT instrument_id, vt, round(lag(close, 3) {W}, 6) AS v, CASE WHEN row_number() {W} <= 3 THEN 'insufficient_history' ELSE 'ok' END AS v_status FROM bars", "bars"))
def f6_lag(spark, sf):
    return _eval(spark, sf, X.lag(CLOSE, 3), status=True)


def _rolling(number: str, op: str, value: str, count: str = "close", q: float | None = None):
    def call(spark, sf):
        return _eval(spark, sf, X.rolling(op, CLOSE, 5, q))

    call.__name__ = f"f{number}_rolling_{op}"
    query(rolling_sql(value, count=count))(call)


_F5 = frame(5)
_SLOPE = f"(covar_pop(close, t) {_F5} / 2.0)"
for _n, _op, _value in (
    ("07", "mean", f"avg(close) {_F5}"), ("08", "sum", f"sum(close) {_F5}"), ("09", "std", f"stddev_pop(close) {_F5}"),
    ("10", "rank", f"len(list_filter(list(close) {_F5}, lambda x: x <= close)) / 5.0"),
    ("11", "slope", _SLOPE), ("12", "residual", f"close - (avg(close) {_F5} + {_SLOPE} * 2.0)"),
    ("13", "rsquare", f"CASE WHEN var_pop(close) {_F5} > 0 THEN pow(covar_pop(close, t) {_F5}, 2) / (var_pop(close) {_F5} * 2.0) ELSE 0.0 END"),
    ("14", "max", f"max(close) {_F5}"), ("15", "min", f"min(close) {_F5}"),
    ("16", "idxmax", f"(list_position(list(close) {_F5}, max(close) {_F5}) - 1)::DOUBLE"), ("17", "idxmin", f"(list_position(list(close) {_F5}, min(close) {_F5}) - 1)::DOUBLE"),
):
    _rolling(_n, _op, _value)
_rolling("18", "quantile", f"list_sort(list(close) {_F5})[4]", q=0.8)

_VX, _VY = (f"var_pop({c}) {frame(6)}" for c in ("close", "volume"))
_CV = f"covar_pop(volume, close) {frame(6)}"
_PSLOPE = f"(CASE WHEN {_VX} > 0 THEN {_CV} / {_VX} ELSE 0.0 END)"
_CORR = f"(CASE WHEN {_VX} > 0 AND {_VY} > 0 THEN {_CV} / (sqrt({_VX}) * sqrt({_VY})) ELSE 0.0 END)"
for _n, _op, _value in (
    ("19", "cov", _CV), ("20", "slope", _PSLOPE), ("21", "residual", f"volume - (avg(volume) {frame(6)} + {_PSLOPE} * (close - avg(close) {frame(6)}))"),
    ("22", "rsquare", f"pow({_CORR}, 2)"), ("23", "corr", _CORR),
):

    def _pair(spark, sf, op=_op):
        return _eval(spark, sf, X.rolling_pair(op, CLOSE, VOLUME, 6))

    _pair.__name__ = f"f{_n}_pair_{_op}"
    query(rolling_sql(_value, 6))(_pair)


_GONE = "user_id % 7 = 0 AND day(ts::DATE) % 2 = 0"


@query(sql("SELECT instrument_id, vt, row_number() OVER (ORDER BY close, instrument_id) / count(*) OVER ()::DOUBLE AS cs FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY vt DESC) = 1) WHERE close IS NOT NULL", "bars").replace("arg_max(value, event_id) AS close", f"CASE WHEN {_GONE} THEN NULL ELSE arg_max(value, event_id) END AS close"))
def f24_cross_section_rank(spark, sf):
    """Every seventh instrument has no close on even days: it has no place if that is its last day."""
    bars = V.bars(spark, sf).withColumn("close", F.when(~((F.col("instrument_id") % 7 == 0) & (F.day("vt") % 2 == 0)), F.col("close")))
    return X.evaluate_cross_section(bars, "rank", CLOSE).select("instrument_id", "vt", "cs")


@query(sql("SELECT cutoff, instrument_id, round((close - avg(close) OVER (PARTITION BY cutoff)) / nullif(stddev_pop(close) OVER (PARTITION BY cutoff), 0), 6) AS cs FROM (SELECT b.*, cutoff FROM bars b JOIN folds ON vt <= cutoff QUALIFY row_number() OVER (PARTITION BY cutoff, instrument_id ORDER BY vt DESC) = 1)", "bars", "folds"))
def f25_cross_section_zscore(spark, sf):
    seen = V.bars(spark, sf).join(F.broadcast(V.folds(spark, sf).select("cutoff")), F.col("vt") <= F.col("cutoff"))
    return X.evaluate_cross_section(seen, "zscore", CLOSE, group=["cutoff"]).select("cutoff", "instrument_id", F.round("cs", 6).alias("cs"))


@query(sql("SELECT instrument_id, vt, close FROM (SELECT * FROM bars WHERE vt <= DATE '2024-01-20' QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY vt DESC) = 1)", "bars"))
def f26_last_rows(spark, sf):
    return X.last_rows(V.bars(spark, sf).filter(F.col("vt") <= F.lit("2024-01-20").cast("date"))).select("instrument_id", "vt", "close")


def _lookback_sql() -> str:
    reach = [(n, 0) for n in (*catalog.BAR, *catalog.PRICE)] + [(f"{n}{w}", family_sql(n, w)[1] - 1) for n in catalog.FAMILIES for w in catalog.WINDOWS]
    return sql(f"SELECT feature, lookback, count(*) FILTER (n <= lookback) AS too_short FROM (SELECT instrument_id, count(*) AS n FROM long_bars GROUP BY instrument_id), (VALUES {', '.join(map(repr, reach))}) f(feature, lookback) GROUP BY ALL", "long_bars")


def f27_lookbacks(spark, sf):
    """Rows that each feature of the catalog reaches back, with the rows of the data that are too short for it."""
    n = V.long_bars(spark, sf).groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n"))
    reach = F.array(*(F.struct(F.lit(k).alias("feature"), F.lit(f.lookback).alias("lookback")) for k, f in catalog.features().items()))
    return n.select(F.explode(reach).alias("f"), "n").groupBy("f.feature", "f.lookback").agg(F.count_if(F.col("n") <= F.col("f.lookback")).alias("too_short"))


# The catalog's families: the value of a window w in SQL, over rows with n rows so far (t), lags pc and pv.
def _change_sql(c: str, p: str, w: int) -> dict[str, str]:
    all_ = f"(sum(abs({c} - {p})) {frame(w)} + 1e-12)"
    up, down = f"sum(greatest({c} - {p}, 0)) {frame(w)}", f"sum(greatest({p} - {c}, 0)) {frame(w)}"
    return {"SUMP": f"{up} / {all_}", "SUMN": f"{down} / {all_}", "SUMD": f"({up} - {down}) / {all_}"}


def family_sql(name: str, w: int) -> tuple[str, int]:
    """(value, rows that it needs)."""
    f, slope = frame(w), f"(covar_pop(close, t) {frame(w)} / {(w * w - 1) / 12!r})"
    qu = lambda q: f"list_sort(list(close) {f})[{int(q * (w - 1)) + 1}] / close"
    at = lambda c, m: f"(list_position(list({c}) {f}, {m}({c}) {f}) - 1)"

    def corr(x: str, y: str) -> str:
        vx, vy = f"var_pop({x}) {f}", f"var_pop({y}) {f}"
        return f"CASE WHEN {vx} > 0 AND {vy} > 0 THEN covar_pop({x}, {y}) {f} / (sqrt({vx}) * sqrt({vy})) ELSE 0.0 END"

    heavy = "abs(close / pc - 1) * volume"
    plain = {
        "MA": f"avg(close) {f} / close", "STD": f"stddev_pop(close) {f} / close", "BETA": f"{slope} / close",
        "RSQR": f"CASE WHEN var_pop(close) {f} > 0 THEN pow(covar_pop(close, t) {f}, 2) / (var_pop(close) {f} * {(w * w - 1) / 12!r}) ELSE 0.0 END",
        "RESI": f"(close - (avg(close) {f} + {slope} * {(w - 1) / 2!r})) / close", "MAX": f"max(high) {f} / close", "MIN": f"min(low) {f} / close",
        "QTLU": qu(0.8), "QTLD": qu(0.2), "RANK": f"len(list_filter(list(close) {f}, lambda x: x <= close)) / {float(w)!r}",
        "RSV": f"(close - min(low) {f}) / (max(high) {f} - min(low) {f} + 1e-12)", "IMAX": f"{at('high', 'max')} / {float(w)!r}", "IMIN": f"{at('low', 'min')} / {float(w)!r}",
        "IMXD": f"({at('high', 'max')} - {at('low', 'min')}) / {float(w)!r}", "CORR": corr("close", "ln(volume + 1)"),
        "VMA": f"avg(volume) {f} / (volume + 1e-12)", "VSTD": f"stddev_pop(volume) {f} / (volume + 1e-12)",
    }
    if name in plain:
        return plain[name], w
    if name == "ROC":
        return f"lag(close, {w}) {W} / close", w + 1
    up, down = (f"avg((close {c} pc)::INT) {f}" for c in "><")
    more = {"CORD": corr("close / pc", "ln(volume / pv + 1)"), "CNTP": up, "CNTN": down, "CNTD": f"{up} - {down}", "WVMA": f"stddev_pop({heavy}) {f} / (avg({heavy}) {f} + 1e-12)"}
    more |= _change_sql("close", "pc", w) | {"V" + k: v for k, v in _change_sql("volume", "pv", w).items()}
    return more[name], w + 1


def _family(name: str) -> None:
    def call(spark, sf):
        found = catalog.compute(V.long_bars(spark, sf), [name])
        return found.select("instrument_id", "vt", *(F.round(f"{name}{w}", 6).alias(f"{name.lower()}{w}") for w in catalog.WINDOWS))

    call.__name__ = f"f28_{name.lower()}"
    columns = []
    for w in catalog.WINDOWS:
        value, need = family_sql(name, w)
        columns.append(f"round(CASE WHEN t >= {need} THEN {value} END, 6) AS {name.lower()}{w}")
    rows = f"(SELECT *, (row_number() {W})::DOUBLE AS t, lag(close) {W} AS pc, lag(volume) {W} AS pv FROM long_bars)"
    query(sql(f"SELECT instrument_id, vt, {', '.join(columns)} FROM {rows}", "long_bars"))(call)


for _name in catalog.FAMILIES:
    _family(_name)
query(_lookback_sql())(f27_lookbacks)

_BAR_SQL = {
    "KMID": "(close - open) / open", "KLEN": "(high - low) / open", "KMID2": "(close - open) / (high - low + 1e-12)", "KUP": "(high - greatest(open, close)) / open",
    "KUP2": "(high - greatest(open, close)) / (high - low + 1e-12)", "KLOW": "(least(open, close) - low) / open", "KLOW2": "(least(open, close) - low) / (high - low + 1e-12)",
    "KSFT": "(2 * close - high - low) / open", "KSFT2": "(2 * close - high - low) / (high - low + 1e-12)", "OPEN0": "open / close", "HIGH0": "high / close", "LOW0": "low / close", "VWAP0": "vwap / close",
}


@query(sql("SELECT instrument_id, vt, " + ", ".join(f"round({v}, 6) AS {k.lower()}" for k, v in _BAR_SQL.items()) + " FROM long_bars", "long_bars"))
def f28_bar_and_price(spark, sf):
    found = catalog.compute(V.long_bars(spark, sf), [*catalog.BAR, *catalog.PRICE])
    return found.select("instrument_id", "vt", *(F.round(k, 6).alias(k.lower()) for k in _BAR_SQL))


def _coverage_sql() -> str:
    """Counts of all features by family, and the totals, from the same expressions that each family is held against."""
    counts = [(name, f"count({value})") for name, value in _BAR_SQL.items()]
    for name in catalog.FAMILIES:
        for w in catalog.WINDOWS:
            value, need = family_sql(name, w)
            counts.append((name, f"count({name.lower()}{w})"))
    inner = ["*", *(f"CASE WHEN t >= {family_sql(n, w)[1]} THEN {family_sql(n, w)[0]} END AS {n.lower()}{w}" for n in catalog.FAMILIES for w in catalog.WINDOWS)]
    rows = f"(SELECT *, (row_number() {W})::DOUBLE AS t, lag(close) {W} AS pc, lag(volume) {W} AS pv FROM long_bars)"
    listed = ", ".join(f"{{'family': '{name.rstrip('0123456789')}', 'n': {count}}}" for name, count in counts)
    return sql(
        f"""SELECT coalesce(family, 'total') AS family, count(*)::INT AS total_count, count(*) FILTER (n > 0)::INT AS expressible_count, round(100.0 * count(*) FILTER (n > 0) / count(*), 2)::DOUBLE AS percentage,
 sum(n)::BIGINT AS "values", any_value(r)::BIGINT AS "rows", 100.0 * count(*) FILTER (n > 0) / count(*) >= 70 AS passes
FROM (SELECT r, f.family AS family, f.n AS n FROM (SELECT count(*) AS r, unnest([{listed}]) AS f FROM (SELECT {', '.join(inner)} FROM {rows}))) GROUP BY GROUPING SETS ((family), ())""",
        "long_bars",
    )


@query(_coverage_sql())
def d16_feature_coverage(spark, sf):
    """How much of the catalog the data can express, by family and in all."""
    return catalog.coverage(V.long_bars(spark, sf))


_ORDINAL = """SELECT {by}, count(*) AS n, round(CASE WHEN count(*) < 2 OR min(signal) = max(signal) OR var_pop(a) * var_pop(b) = 0 THEN 0.0 ELSE covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)) END, 6) AS rank_ic
FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY signal, instrument_id)::DOUBLE AS a, row_number() OVER (PARTITION BY {by} ORDER BY fwd, instrument_id)::DOUBLE AS b FROM ({rows})) GROUP BY {by}"""
_CLOSE_ROWS = "SELECT b.instrument_id, b.vt, b.close AS signal, fwd FROM bars b JOIN labels_next USING (instrument_id, vt)"


def _signal_labels(spark, sf):
    bars = V.bars(spark, sf)
    return bars.select("instrument_id", "vt", F.col("close").alias("signal")).join(L.next_day_returns(bars, V.calendar(spark, sf)), ["instrument_id", "vt"])


@query(sql(_ORDINAL.format(by="vt", rows=_CLOSE_ROWS), "bars", "labels_next"))
def d3_rank_ic(spark, sf):
    return L.rank_ic(_signal_labels(spark, sf), ["vt"]).withColumn("rank_ic", F.round("rank_ic", 6))


_AVERAGE = f"""SELECT vt, count(*) AS n, round(CASE WHEN count(*) >= 2 AND var_pop(a) > 0 AND var_pop(b) > 0 THEN covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)) END, 6) AS rank_ic
FROM (SELECT vt, (rank() OVER (PARTITION BY vt ORDER BY signal) + (count(*) OVER (PARTITION BY vt, signal) - 1) / 2.0)::DOUBLE AS a,
 (rank() OVER (PARTITION BY vt ORDER BY fwd) + (count(*) OVER (PARTITION BY vt, fwd) - 1) / 2.0)::DOUBLE AS b FROM ({_CLOSE_ROWS})) GROUP BY vt"""


@query(sql(_AVERAGE, "bars", "labels_next"))
def d4_spearman(spark, sf):
    return L.spearman_by_day(_signal_labels(spark, sf), ["vt"]).withColumn("rank_ic", F.round("rank_ic", 6))


@query(sql(f"SELECT round(coalesce(avg(rank_ic), 0.0), 4) AS mean_ic, count(rank_ic) AS days FROM ({_AVERAGE})", "bars", "labels_next"))
def d4_mean_spearman(spark, sf):
    return L.mean_ic(d4_spearman(spark, sf)).withColumn("mean_ic", F.round("mean_ic", 4))


@query(sql(f"SELECT round(avg(rank_ic), 4) AS mean_ic, count(rank_ic) AS days FROM ({_ORDINAL.format(by='vt', rows=_CLOSE_ROWS)})", "bars", "labels_next"))
def d5_mean_rank_ic(spark, sf):
    return L.rank_ic(_signal_labels(spark, sf), ["vt"]).select(F.round("rank_ic", 6).alias("rank_ic")).agg(F.round(F.avg("rank_ic"), 4).alias("mean_ic"), F.count("rank_ic").alias("days"))


@query(sql("SELECT b.vt, count(*) FILTER (fwd IS NOT NULL) AS usable, count(*) AS signals FROM bars b LEFT JOIN labels_next USING (instrument_id, vt) GROUP BY b.vt", "bars", "labels_next"))
def d6_usable_signals(spark, sf):
    bars = V.bars(spark, sf)
    met = bars.select("instrument_id", "vt", "close").join(L.next_day_returns(bars, V.calendar(spark, sf)), ["instrument_id", "vt"], "left")
    return met.groupBy("vt").agg(F.count_if(F.col("close").isNotNull() & F.col("fwd").isNotNull()).alias("usable"), F.count(F.lit(1)).alias("signals"))


_FOLD_BARS = "SELECT b.*, fold_id, cutoff, next_day FROM bars b JOIN folds ON vt <= cutoff AND kt <= cutoff"
_FOLD_LABEL = "SELECT f.fold_id, l.instrument_id, l.fwd FROM labels_next l JOIN folds f ON l.vt = f.cutoff"


def _score_sql(signal: str) -> str:
    ic = _ORDINAL.format(by="fold_id", rows=f"SELECT * FROM sig JOIN ({_FOLD_LABEL}) USING (fold_id, instrument_id) WHERE signal IS NOT NULL")
    tail = f", sig AS ({signal}) SELECT s.fold_id, count(signal) AS n_signals, round(coalesce(avg(signal), 0.0), 6) AS mean_signal, coalesce(any_value(rank_ic), 0.0) AS rank_ic FROM sig s LEFT JOIN ({ic}) i USING (fold_id) GROUP BY s.fold_id"
    return sql("@", "bars", "folds", "labels_next").replace("\n@", tail)


_LAST = f"SELECT fold_id, instrument_id, {{v}} AS signal FROM (SELECT *, count(*) OVER (PARTITION BY fold_id, instrument_id) AS k, row_number() OVER (PARTITION BY fold_id, instrument_id ORDER BY vt DESC) AS r, lag(close) OVER w AS pc, avg(close) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m3 FROM ({_FOLD_BARS}) WINDOW w AS (PARTITION BY fold_id, instrument_id ORDER BY vt)) WHERE r = 1 AND k >= {{least}}"


def _facts(spark, sf):
    folds = V.folds(spark, sf)
    return B.as_of_folds(V.bars(spark, sf).withColumn("revision", F.lit(0)), folds, ("instrument_id", "vt"))


def _scored(spark, sf, signals):
    labels = E.fold_labels(V.bars(spark, sf).withColumn("revision", F.lit(0)), V.folds(spark, sf), V.calendar(spark, sf))
    found = E.score(signals, labels)
    return found.select("fold_id", "n_signals", F.round("mean_signal", 6).alias("mean_signal"), F.round("rank_ic", 6).alias("rank_ic"))


@query(_score_sql(_LAST.format(v="m3", least=3)))
def e1_sma3_walk_forward(spark, sf):
    return _scored(spark, sf, E.fold_signal(_facts(spark, sf), E.sma(3), 3))


@query(_score_sql(_LAST.format(v="close - pc", least=2)))
def e2_momentum(spark, sf):
    return _scored(spark, sf, E.fold_signal(_facts(spark, sf), E.momentum(), 2))


@query(_score_sql(f"SELECT fold_id, instrument_id, row_number() OVER (PARTITION BY fold_id ORDER BY s, instrument_id) / count(*) OVER (PARTITION BY fold_id)::DOUBLE AS signal FROM ({_LAST.format(v='close', least=1).replace('AS signal', 'AS s')})"))
def e3_cross_section(spark, sf):
    cs = X.evaluate_cross_section(_facts(spark, sf), "rank", CLOSE, group=["fold_id"])
    return _scored(spark, sf, cs.select("fold_id", "instrument_id", F.col("cs").alias("signal")))


@query(_score_sql(f"SELECT fold_id, instrument_id, close AS signal FROM ({_FOLD_BARS}) WHERE vt = cutoff"))
def e4_buy_and_hold(spark, sf):
    return _scored(spark, sf, E.buy_and_hold(_facts(spark, sf)))


_PANEL = """SELECT instrument_id, vt, close, CASE WHEN count(close) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 3 THEN close / nullif(avg(close) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0) - 1 END AS b1,
 CASE WHEN count(close) OVER (w ROWS UNBOUNDED PRECEDING) >= 3 THEN close / nullif(avg(close) OVER (w ROWS UNBOUNDED PRECEDING), 0) - 1 END AS b2, close / nullif(lag(close) OVER w, 0) - 1 AS b3,
 first_value(close) OVER (w ROWS UNBOUNDED PRECEDING) AS b5, (rank() OVER (PARTITION BY vt ORDER BY close) + (count(*) OVER (PARTITION BY vt, close) - 1) / 2.0) / count(*) OVER (PARTITION BY vt) AS b4
 FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY vt)"""


@query(sql(f"SELECT instrument_id, vt, round(b1, 6) AS b1, round(b2, 6) AS b2, round(b3, 6) AS b3, round(b4, 6)::DOUBLE AS b4, b5 FROM ({_PANEL})", "bars"))
def e5_panel_signals(spark, sf):
    p = E.panel_signals(V.bars(spark, sf))
    return p.select("instrument_id", "vt", *(F.round(b, 6).alias(b) for b in ("b1", "b2", "b3", "b4")), "b5")


@query(sql("SELECT instrument_id, vt, round(lead(close) OVER (PARTITION BY instrument_id ORDER BY vt) / nullif(close, 0) - 1, 6) AS fwd FROM bars", "bars"))
def e6_grid_forward_return(spark, sf):
    w = Window.partitionBy("instrument_id").orderBy("vt")
    return V.bars(spark, sf).select("instrument_id", "vt", F.round(F.try_divide(F.lead("close").over(w), F.col("close")) - 1, 6).alias("fwd"))


@query(sql("SELECT vt, scenario, count(*) AS n, round(avg(fwd - turnover * bps / 10000), 6) AS net FROM (SELECT *, 1.0 AS turnover FROM labels_next) CROSS JOIN (VALUES ('c-free', 0.0::DOUBLE), ('c-stress2x', 30.0::DOUBLE)) s(scenario, bps) GROUP BY ALL", "labels_next"))
def e8_cost_adjusted_returns(spark, sf):
    from ..operators import costs

    rows = L.next_day_returns(V.bars(spark, sf), V.calendar(spark, sf)).withColumn("turnover", F.lit(1.0))
    return costs.in_all_scenarios(rows, "fwd").groupBy("vt", "scenario").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("net"), 6).alias("net"))


_SCENARIOS = "(VALUES ('c-free', 0.0::DOUBLE), ('c-stress2x', 30.0::DOUBLE)) s(scenario, bps)"


@query(sql(_ORDINAL.format(by="vt, scenario", rows=f"SELECT instrument_id, vt, scenario, signal, fwd - 1.0 * bps / 10000.0 AS fwd FROM ({_CLOSE_ROWS}) CROSS JOIN {_SCENARIOS}"), "bars", "labels_next"))
def e8_cost_adjusted_ic(spark, sf):
    """Rank IC of the close with next-day returns before and after costs."""
    from ..operators import costs

    rows = costs.in_all_scenarios(_signal_labels(spark, sf).withColumn("turnover", F.lit(1.0)), "fwd")
    return L.rank_ic(rows, ["vt", "scenario"], ret="net").withColumn("rank_ic", F.round("rank_ic", 6))


_GRID = {f"mean_close_{w}": ("close", w, "avg") for w in (2, 3, 5)} | {f"std_volume_{w}": ("volume", w, "stddev_pop") for w in (2, 4)} | {f"sum_high_{w}": ("high", w, "sum") for w in (3,)}
_GRID_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS candidate, avg(v) AS score, count(v) = count(*) AS valid FROM (SELECT instrument_id, vt, CASE WHEN count({c}) {frame(w)} >= {w} THEN {f}({c}) {frame(w)} END AS v, count(*) OVER (PARTITION BY instrument_id) AS k FROM bars QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY vt DESC) = 1) WHERE k >= 3"
    for n, (c, w, f) in _GRID.items()
)


def _candidates(spark, sf):
    ops = {"avg": "mean", "stddev_pop": "std", "sum": "sum"}
    return S.candidate_values(V.bars(spark, sf), {n: X.rolling(ops[f], X.field(c), w) for n, (c, w, f) in _GRID.items()})


@query(sql(f"SELECT candidate, round(CASE WHEN valid THEN score END, 6) AS score, valid FROM ({_GRID_SQL})", "bars"))
def l1_score_candidates(spark, sf):
    return S.score_candidates(_candidates(spark, sf)).select("candidate", F.round("score", 6).alias("score"), "valid")


@query()
def l2_candidate_rank_ic(spark, sf):
    """Rank IC of every candidate of the full grid at every fold, with its p-value and the discoveries over all of them."""
    labels = E.fold_labels(V.bars(spark, sf).withColumn("revision", F.lit(0)), V.folds(spark, sf), V.calendar(spark, sf))
    ic = written(S.candidate_rank_ic(_facts(spark, sf), S.factor_grid(), labels), "ic")  # a row for each fold and candidate, read several times
    return S.benjamini_hochberg(ic.withColumn("p", S.spearman_p(F.col("rank_ic"), F.col("n")))).select("fold_id", "candidate", "n", F.round("rank_ic", 6).alias("rank_ic"), F.round("p", 6).alias("p"), "accepted")


def _grid_sql() -> str:
    fields, ops = ("close", "volume", "open", "high", "low"), {"mean": "avg", "std": "stddev_pop", "sum": "sum"}
    signs = {"add": "+", "sub": "-", "mul": "*"}
    made = {f"{op}_{c}_{w}": f"CASE WHEN t >= {w} THEN {f}({c}::DOUBLE) {frame(w)} END" for c in fields for op, f in ops.items() for w in range(2, 11)}
    made |= {f"{op}_{c}_lag{k}": f"{c}::DOUBLE {sign} lag({c}, {k}) {W}" for c in fields for op, sign in signs.items() for k in range(1, 6)}
    wide = f"SELECT {', '.join(f'{v} AS {n}' for n, v in made.items())}, row_number() OVER (PARTITION BY instrument_id ORDER BY vt DESC) AS r, count(*) OVER (PARTITION BY instrument_id) AS k FROM (SELECT *, row_number() {W} AS t FROM bars)"
    each = " UNION ALL ".join(f"SELECT '{n}' AS candidate, CASE WHEN count({n}) = count(*) THEN round(avg({n}), 6) END AS score, count({n}) = count(*) AS valid, CASE WHEN count({n}) < count(*) THEN 'insufficient_history' END AS error FROM last" for n in made)
    return sql("@", "bars").replace("\n@", f", last AS MATERIALIZED (SELECT * FROM ({wide}) WHERE r = 1 AND k >= 3) {each}")


@query(_grid_sql())
def l3_factor_grid(spark, sf):
    """Every candidate of the full grid over the bars: score and validity."""
    return S.score_candidates(S.candidate_values(V.bars(spark, sf), S.factor_grid())).withColumn("score", F.round("score", 6))


_RHO = "SELECT vt, n, rank_ic FROM (" + _ORDINAL.format(by="vt", rows=_CLOSE_ROWS) + ")"


@query(sql(f"SELECT vt, n, round(CASE WHEN n < 3 THEN 1.0 WHEN abs(rank_ic) >= 1 THEN 1e-6 ELSE least(greatest(1 / (1 + rank_ic * rank_ic * (n - 2) / (1 - rank_ic * rank_ic)), 1e-6), 1.0) END, 6) AS p FROM ({_RHO})", "bars", "labels_next"))
def l4_simple_p_value(spark, sf):
    ic = L.rank_ic(_signal_labels(spark, sf), ["vt"]).withColumn("rank_ic", F.round("rank_ic", 6))
    return ic.select("vt", "n", F.round(S.spearman_p_simple(F.col("rank_ic"), F.col("n")), 6).alias("p"))


@query()
def l4_spearman_p_value(spark, sf):
    ic = L.rank_ic(_signal_labels(spark, sf), ["vt"])
    return ic.select("vt", "n", F.round("rank_ic", 6).alias("rank_ic"), F.round(S.spearman_p(F.col("rank_ic"), F.col("n")), 6).alias("p"))


@query(sql("SELECT doc_id, lane, coalesce(p <= (SELECT max(p) FROM (SELECT p, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS r, count(*) OVER () AS m FROM pvalues) WHERE p <= 0.05 * r / m), false) AS accepted FROM pvalues", "pvalues"))
def l5_benjamini_hochberg(spark, sf):
    return S.benjamini_hochberg(V.pvalues(spark, sf)).select("doc_id", "lane", "accepted")


@query(sql("SELECT lane, round(max(p), 6) AS best, round(median(p), 6) AS median, count(p) >= 2 AND max(p) - median(p) < 0.05 AS artifact FROM pvalues GROUP BY lane", "pvalues"))
def l6_search_artifact(spark, sf):
    return S.search_artifact(V.pvalues(spark, sf), score="p").select("lane", F.round("best", 6).alias("best"), F.round("median", 6).alias("median"), "artifact")


def _trials(spark, sf):
    e = V.table(spark, sf, "events")
    return e.select(F.col("event_type").alias("lane"), (F.col("value") > 5).alias("valid"), (F.col("value") / 100).alias("score"), (F.col("event_id") % 100 / 100 - 0.5).alias("ic"))


_TRIALS = "(SELECT event_type AS lane, value > 5 AS valid, value / 100 AS score, (event_id % 100) / 100.0::DOUBLE - 0.5 AS ic FROM events)"


@query(f"SELECT lane, count(*) AS n, count(*) FILTER (valid) AS n_valid, count(*) FILTER (NOT valid) AS n_invalid, round(median(score) FILTER (valid), 6) AS median_score, round(max(score) FILTER (valid), 6) AS best_score, round(median(ic) FILTER (valid), 6) AS median_ic, round(max(ic) FILTER (valid), 6) AS best_ic FROM {_TRIALS} GROUP BY lane")
def d7_scorecard(spark, sf):
    found = S.scorecard(_trials(spark, sf))
    return found.select("lane", "n", "n_valid", "n_invalid", *(F.round(c, 6).alias(c) for c in ("median_score", "best_score", "median_ic", "best_ic")))


@query(f"SELECT count(*) AS n_trials, count(*) FILTER (valid) AS n_valid, count(*) FILTER (NOT valid) AS n_invalid FROM {_TRIALS}")
def d15_batch_summary(spark, sf):
    return _trials(spark, sf).agg(F.count(F.lit(1)).alias("n_trials"), F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_invalid"))


@query()
def l8_boosted_trees(spark, sf):
    """Next-day returns of the last fifth of the days, predicted by trees that were fitted on the days before."""
    bars = V.bars(spark, sf)
    named = {"r1": X.binary("div", CLOSE, X.lag(CLOSE, 1)), "m5": X.binary("div", CLOSE, X.rolling("mean", CLOSE, 5)), "v5": X.rolling("std", VOLUME, 5)}
    rows = X.evaluate(bars, named, status=False).join(L.next_day_returns(bars, V.calendar(spark, sf)), ["instrument_id", "vt"])
    return S.boosted_trees(rows, list(named)).select("instrument_id", "vt", "fwd", "prediction")


@query(sql("SELECT b.vt, count(*) AS pairs FROM bars b JOIN labels_next l USING (instrument_id, vt) WHERE b.close IS NOT NULL AND fwd IS NOT NULL GROUP BY b.vt", "bars", "labels_next"))
def c11_index_intersection(spark, sf):
    return _signal_labels(spark, sf).dropna(subset=["signal", "fwd"]).groupBy("vt").agg(F.count(F.lit(1)).alias("pairs"))


_FOUR = {
    "mean3": (3, "avg(close) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"), "std5": (5, "stddev_pop(close) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"),
    "rank5": (5, "len(list_filter(list(close) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), lambda x: x <= close)) / 5.0"), "slope4": (4, "covar_pop(close, t) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) / 1.25"),
}


def _mutual_sql() -> str:
    rows = f"SELECT *, row_number() OVER (PARTITION BY fold_id, instrument_id ORDER BY vt)::DOUBLE AS t FROM ({_FOLD_BARS})"
    columns = ", ".join(f"CASE WHEN t >= {n} THEN {v} END AS {name}" for name, (n, v) in _FOUR.items())
    wide = f"SELECT fold_id, instrument_id, t, {columns}, row_number() OVER (PARTITION BY fold_id, instrument_id ORDER BY vt DESC) AS r FROM ({rows}) WINDOW w AS (PARTITION BY fold_id, instrument_id ORDER BY vt)"
    long = " UNION ALL ".join(f"SELECT fold_id, instrument_id, '{n}' AS candidate, {n} AS v FROM wide WHERE r = 1 AND t >= 3 AND {n} IS NOT NULL" for n in _FOUR)
    pairs = "SELECT a.fold_id, a.instrument_id, a.candidate, b.candidate AS other, a.v AS signal, b.v AS fwd FROM long a JOIN long b ON a.fold_id = b.fold_id AND a.instrument_id = b.instrument_id AND a.candidate < b.candidate"
    return sql("@", "bars", "folds").replace("\n@", f", wide AS MATERIALIZED ({wide}), long AS MATERIALIZED ({long}) " + _ORDINAL.format(by="fold_id, candidate, other", rows=pairs))


def _mutual_values(spark, sf):
    named = {n: X.rolling(op, CLOSE, w) for n, op, w in (("mean3", "mean", 3), ("std5", "std", 5), ("rank5", "rank", 5), ("slope4", "slope", 4))}
    return S.candidate_values(_facts(spark, sf), named, ("fold_id", "instrument_id"))


@query(_mutual_sql())
def l7_mutual_ic(spark, sf):
    """Rank correlation of every two candidates over the instruments that have both, at each fold."""
    return S.mutual_ic(_mutual_values(spark, sf).filter("status = 'ok'")).withColumn("rank_ic", F.round("rank_ic", 6))



_CAMPAIGN = {
    "B1": _LAST.format(v="m3", least=3), "B3": _LAST.format(v="close - pc", least=2),
    "B4": f"SELECT fold_id, instrument_id, row_number() OVER (PARTITION BY fold_id ORDER BY s, instrument_id) / count(*) OVER (PARTITION BY fold_id)::DOUBLE AS signal FROM ({_LAST.format(v='close', least=1).replace('AS signal', 'AS s')})",
    "B5": f"SELECT fold_id, instrument_id, close AS signal FROM ({_FOLD_BARS}) WHERE vt = cutoff",
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS experiment_id, fold_id, n_signals, rank_ic, 0 AS n_violations FROM ({_score_sql(signal)})" for name, signal in _CAMPAIGN.items()))
def e7_campaign(spark, sf):
    """The baselines' fold scores as trial artifacts, through the gate."""
    from ..operators import rules

    facts = _facts(spark, sf)
    cs = X.evaluate_cross_section(facts, "rank", CLOSE, group=["fold_id"]).select("fold_id", "instrument_id", F.col("cs").alias("signal"))
    signals = {"B1": E.fold_signal(facts, E.sma(3), 3), "B3": E.fold_signal(facts, E.momentum(), 2), "B4": cs, "B5": E.buy_and_hold(facts)}
    all_ = None
    for name, rows in signals.items():
        own = _scored(spark, sf, rows.select("fold_id", "instrument_id", "signal")).withColumn("experiment_id", F.lit(name))
        all_ = own if all_ is None else all_.unionByName(own)
    sha = lambda *c: F.sha2(F.concat_ws("/", *c), 256)
    run = sha(F.col("experiment_id"), F.col("fold_id").cast("string"))
    made = all_.withColumns({n: sha(F.lit(n), F.col("experiment_id")) for n in rules.HASHES})
    made = made.withColumns(
        {
            "run_id": run, "seeds": F.array(F.lit(0)), "split_policy_ref": F.lit("walk-forward"), "cost_model_ref": F.lit("c-free"), "agent_origin": F.lit("baseline"), "status": F.lit("success"),
            "artifacts": F.create_map(F.lit("signal"), run), "metrics": F.create_map(F.lit("rank_ic"), F.col("rank_ic")),
        }
    )
    return rules.gate(made).select("experiment_id", "fold_id", "n_signals", "rank_ic", F.size("violations").alias("n_violations"))

"""Decision rules over the calibration table: (rule, observed, decision) rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens import fixed
from runlens.fixed import (
    CONDITION_TAIL,
    D8_BEST,
    D8_MEETS,
    D8_NONE,
    ENTERS,
    EXCLUDED,
    NOT_EVALUABLE,
    NO_BUDGET,
    NO_COMPARISON,
    PIVOT,
    STARTS,
    TEXT_PRIMARY,
    TEXT_STAYS,
    VISION_PRIMARY,
)
from runlens.functions.numbers import fixed_digits

c = F.col
ROW = ["rule", "observed", "decision"]


def _row(rule: Column, observed: Column, decision: Column) -> list[Column]:
    return [rule.alias("rule"), observed.alias("observed"), decision.alias("decision")]


def _tagged(name: str) -> Column:
    return F.concat(F.lit(name + ":"), c("source"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _enters(th: dict) -> Column:
    return F.coalesce(
        c("pass_rate").between(th["pass_rate_min"], th["pass_rate_max"])
        & (c("aa_delta_points") <= th["aa_band_max_points"])
        & (c("clusters_with_two") >= th["min_clusters_with_two"]),
        F.lit(False),
    )


def decision_rules(
    calibration: DataFrame,
    extras: DataFrame,
    choices: DataFrame | None = None,
    parity: DataFrame | None = None,
    budget: float | None = None,
    thresholds: dict | None = None,
) -> DataFrame:
    """D1, D2, D3, D1prime, D4 to D8 and the parity rows; NULL inputs are "not evaluable".

    ``calibration``: source, position, pass_rate, aa_delta_points, heldout_delta_points,
    clusters_with_two, primary_clusters, has_runs. ``extras`` is one row: cost_per_rollout,
    judge_self_consistency, judge_self_consistency_vision, vision_disagreement, vision_compared.
    ``choices`` come from ``mde_choice``, ``parity`` holds (source, ok). One row per source, so
    every rule is a projection or a small aggregate.
    """
    th = {**fixed.THRESHOLDS, **(thresholds or {})}
    cal = calibration.withColumn("enters", c("has_runs") & _enters(th))
    delta = fixed_digits(c("aa_delta_points"), 2)
    out = [
        cal.select(*_row(
            _tagged("D1"),
            F.when(c("has_runs"), _text("pass_rate=", fixed_digits(c("pass_rate")), " aa_delta=", delta,
                                        " clusters_with_two=", c("clusters_with_two"))).otherwise("no B1 runs"),
            F.when(~c("has_runs"), NOT_EVALUABLE).when(c("enters"), ENTERS).otherwise(EXCLUDED),
        )),
        cal.where("has_runs").select(*_row(
            _tagged("D2"), _text("primary_clusters=", c("primary_clusters")),
            _text(c("primary_clusters"), " primary; rest secondary"),
        )),
    ]
    search = c("source").isin(fixed.SEARCH_SOURCES)
    widest = cal.where(~search & c("has_runs")).agg(F.max("aa_delta_points")).scalar()
    band = cal.where(search).withColumn("_widest", widest)
    known = c("has_runs") & c("aa_delta_points").isNotNull() & c("_widest").isNotNull()
    keep = c("enters") & (c("aa_delta_points") <= th["search_band_ratio_max"] * F.greatest(c("_widest"), F.lit(1e-9)))
    out.append(band.select(*_row(
        _tagged("D3"),
        F.when(known, _text("aa_delta=", delta, " widest_other=", fixed_digits(c("_widest"), 2))).otherwise("missing A/A data"),
        F.when(~known, NOT_EVALUABLE).when(keep, "stays in E2").otherwise("descriptive only"),
    )))
    minimum = int(th["min_total_primary_clusters"])
    names = F.transform(
        F.array_sort(F.collect_list(F.when(c("enters"), F.struct("position", "source")))), lambda x: _text("'", x["source"], "'")
    )
    totals = cal.agg(
        F.coalesce(F.sum(F.when(c("enters"), c("primary_clusters"))), F.lit(0)).alias("included"),
        F.coalesce(F.sum(F.when(c("has_runs"), c("primary_clusters"))), F.lit(0)).alias("primary"),
        F.concat(F.lit("["), F.concat_ws(", ", names), F.lit("]")).alias("names"),
    )
    out.append(totals.select(*_row(
        F.lit("D1prime"),
        _text("primary_clusters_in_included_sources=", c("included"), f" (min {minimum}); included=", c("names")),
        F.when(c("included") >= minimum, STARTS).otherwise(PIVOT),
    )))
    unit = extras.select("cost_per_rollout").scalar()
    cost = totals.withColumn("_unit", unit.cast("double"))
    spend = lambda k: F.lit(float(th["e2_arms"])) * c("primary") * k * c("_unit")
    shown = lambda k: _text(f"projected_usd(k={k})=", fixed_digits(spend(k), 2), f" budget={budget}")
    missing = F.lit(budget is None) | c("_unit").isNull()
    fits = spend(3) <= F.lit(budget if budget is not None else 0.0)
    out.append(cost.select(*_row(
        F.lit("D4"),
        F.when(missing, _text("primary_clusters=", c("primary"), f" budget={budget}")).when(fits, shown(3)).otherwise(shown(2)),
        F.when(missing, NO_BUDGET).when(fits, "k=3").otherwise("k=2"),
    )))
    held = c("heldout_delta_points")
    wide = held > th["aa_band_max_points"]
    out.append(cal.select(*_row(
        _tagged("D5"),
        F.when(c("has_runs") & held.isNotNull(), _text("heldout_delta=", fixed_digits(held, 2))).otherwise("no held-out A/A"),
        F.when(~c("has_runs") | held.isNull(), NOT_EVALUABLE)
        .when(wide, f"{int(th['heldout_per_source_wide'])}/source")
        .otherwise(f"{int(th['heldout_per_source'])}/source"),
    )))
    sc, vsc, dis = (c(x) for x in ("judge_self_consistency", "judge_self_consistency_vision", "vision_disagreement"))
    low = th["judge_self_consistency_min"]
    out.append(extras.select(*_row(
        F.lit("D6"),
        F.when(sc.isNull(), "no judge calibration").otherwise(
            _text("text_self_consistency=", fixed_digits(sc), " (Flash re-judge replaced by P1)")),
        F.when(sc.isNull(), NOT_EVALUABLE).when(sc < low, "2-of-3 judge vote").otherwise("single judge"),
    )))
    blind = vsc.isNull() | dis.isNull()
    out.append(extras.select(*_row(
        F.lit("D7"),
        F.when(blind, "no vision calibration or no dual-scored gdpval artifacts").otherwise(
            _text("vision_self_consistency=", fixed_digits(vsc), " text_vs_vision_disagreement=", fixed_digits(dis),
                  " compared=", c("vision_compared"))),
        F.when(blind, TEXT_STAYS).when((vsc >= low) & (dis >= th["vision_disagreement_min"]), VISION_PRIMARY).otherwise(TEXT_PRIMARY),
    )))
    if choices is not None:
        mde, meaningful = fixed_digits(c("mde"), 2), th["delta_meaningful_points"]
        out.append(choices.select(*_row(
            _tagged("D8"),
            _text(c("choice"), " MDE=", mde, " points cost=", fixed_digits(c("cost_usd"), 2), f" USD (delta_meaningful={meaningful})"),
            F.when(c("meets_d8"), D8_MEETS).when(c("within_budget"), _text(D8_BEST, mde, " points")).otherwise(
                _text(D8_NONE, mde, " points")),
        )))
    if parity is not None:
        out.append(parity.select(*_row(
            _tagged("COH-WRONG"),
            F.when(c("ok").isNull(), "parity not judged").when(c("ok"), "parity ok").otherwise("parity not reached"),
            F.when(c("ok").isNull(), NOT_EVALUABLE).when(c("ok"), "arm admitted").otherwise(
                "persistent parity violation recorded; arm reported with the caveat"),
        )))
    return reduce(DataFrame.unionByName, out)


def primary_of(decisions: DataFrame) -> DataFrame:
    """(source, primary_clusters) read back from the D2 rows of a decision table."""
    number = F.regexp_extract("observed", r"primary_clusters=(\d+)", 1)
    return decisions.where(c("rule").startswith("D2:") & (number != "")).select(
        F.substring_index("rule", ":", -1).alias("source"), number.cast("int").alias("primary_clusters")
    )


def compare_conditions(this: DataFrame, other: DataFrame, this_name: str, other_name: str) -> DataFrame:
    """Primary clusters per source under two conditions: the larger wins, ties go to the other.

    Both inputs are decision tables. A source the other one does not have is not evaluable.
    """
    a = primary_of(this)
    b = primary_of(other).withColumnRenamed("primary_clusters", "_other")
    rows = a.join(b, "source", "left")
    wins = c("primary_clusters") > c("_other")
    chosen = F.when(wins, this_name).otherwise(other_name)
    n = F.when(wins, c("primary_clusters")).otherwise(c("_other"))
    gone = c("_other").isNull()
    return rows.select(*_row(
        _tagged("D1prime2"),
        F.when(gone, _text(f"{this_name}=", c("primary_clusters"), f" {other_name}=unknown")).otherwise(
            _text(f"primary clusters: {this_name}=", c("primary_clusters"), f" {other_name}=", c("_other"), f" (ties go to {other_name})")),
        F.when(gone, NO_COMPARISON).otherwise(_text("E2 under ", chosen, " with N=", n, CONDITION_TAIL)),
    ))

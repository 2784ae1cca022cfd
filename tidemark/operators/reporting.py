"""Rules of reporting: no estimate without its placebos, no slope without its influence diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.sinks import markdown


class MissingPlacebos(ValueError):
    """An estimate has no placebo distribution."""


class MissingInfluence(ValueError):
    """A slope has no influence diagnostics."""


def require_placebos(estimates: DataFrame, placebos: DataFrame, *key: str) -> DataFrame:
    """The estimates, or a refusal that names those without placebos."""
    bare = estimates.select(*key).distinct().join(placebos.select(*key).distinct(), list(key), "left_anti").limit(5).collect()
    if bare:
        raise MissingPlacebos(", ".join(str(tuple(r)) for r in bare))
    return estimates


def report_separately(events: DataFrame) -> DataFrame:
    """(..., flagged): high anticipation, a confounder or a leak sets an event apart."""
    return events.withColumn("flagged", (F.lower("risk") == "high") | (F.trim("confounder") != "") | (F.trim("leak_note") != ""))


def prefit_verdict(ratio):
    """SPANS up to 0.9 of the baseline's error, MARGINAL up to 1.1, else FAILS; null without a ratio."""
    return F.when(ratio.isNull(), None).when(ratio <= 0.9, "SPANS").when(ratio <= 1.1, "MARGINAL").otherwise("FAILS")


def influence_verdict(concentrated: bool, survives: bool, agrees: bool) -> str:
    """FRAGILE if the drop path breaks the slope or its forms disagree, CAUTION if leverage is concentrated, else ROBUST."""
    if not survives or not agrees:
        return "FRAGILE"
    return "CAUTION" if concentrated else "ROBUST"


def survives_drop_path(path: DataFrame) -> bool:
    """Whether each step keeps the full slope's sign and at least half of its size."""
    rows = {r["k"]: r["beta"] for r in path.collect()}
    full = rows.pop(0)
    return all(b is not None and b * full > 0 and abs(b) >= 0.5 * abs(full) for b in rows.values())


def render(title: str, events: DataFrame, estimates: DataFrame, placebos: DataFrame) -> str:
    """A report in two parts, clean events first; refused where placebos are missing."""
    rows = require_placebos(estimates, placebos, "event_id").join(report_separately(events).select("event_id", "flagged"), "event_id")
    clean, apart = rows.where("not flagged").drop("flagged").orderBy("event_id"), rows.where("flagged").drop("flagged").orderBy("event_id")
    return f"# {title}\n\n{markdown(clean)}\n\n## Reported separately\n\n{markdown(apart)}\n"


def dose_section(error: DataFrame, influence: DataFrame | None) -> str:
    if influence is None:
        raise MissingInfluence("a slope is reported with its influence diagnostics")
    return f"{markdown(error)}\n\n{markdown(influence)}\n"


def dose_headline(boot: DataFrame, influence: DataFrame, leverage: DataFrame, detectable: DataFrame, sign: DataFrame | None = None, level: float = 0.05) -> DataFrame:
    """One row that a reader must see of a slope: figures, floor, effective firms, verdicts, and whether every structural check passed (``trustworthy``).

    ``boot`` beta, p_wild, p_floor, p_random, at_the_floor; ``influence`` survives,
    agrees, concentrated, verdict; ``leverage`` nominal_firms, effective_firms;
    ``detectable`` mde; ``sign`` signs_oppose, underpowered, verdict, or nothing where
    the test was not run.  The checks are about the design, not about the size of
    p: the level is attainable, p is not pinned at its floor, the drop path and
    the forms hold, and the sign test passes where it has the power to fail.
    Refused without influence diagnostics.
    """
    if influence is None or influence.isEmpty():
        raise MissingInfluence("a slope is reported with its influence diagnostics")
    beside = lambda row, other: row.crossJoin(F.broadcast(other.limit(1)))  # noqa: E731 - one row each
    row = beside(boot.limit(1), influence.select("survives", "agrees", "concentrated", F.col("verdict").alias("influence")))
    row = beside(beside(row, leverage.select("nominal_firms", "effective_firms")), detectable.select("mde"))
    if sign is None:
        row = row.withColumns({"sign_test": F.lit(None).cast("string"), "_sign": F.lit(True)})
    else:
        row = beside(row, sign.select(F.col("verdict").alias("sign_test"), (F.col("underpowered") | F.col("signs_oppose")).alias("_sign")))
    reachable = F.col("p_floor") <= level
    trust = reachable & ~F.col("at_the_floor") & F.col("survives") & F.col("agrees") & F.col("_sign")
    return row.select("beta", "p_wild", "p_floor", "p_random", "mde", "nominal_firms", "effective_firms", "survives", "agrees", "concentrated", "influence", "sign_test", reachable.alias("reachable"), "at_the_floor", F.coalesce(trust, F.lit(False)).alias("trustworthy"))


def _notes(*pairs: tuple[Column, Column | str]) -> Column:
    """(place, note) of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("place"), (note if isinstance(note, Column) else F.lit(note)).alias("note"))) for n, (c, note) in enumerate(pairs)]))


def dose_caveats(headline: DataFrame) -> DataFrame:
    """(place, note): what has to be said beside a slope, in order."""
    percent = F.format_string("%.4f", "p_floor")
    notes = _notes(
        (~F.col("reachable"), F.concat(F.lit("p has a floor of "), percent, F.lit(", above the level: no effect of any size could be significant"))),
        (F.col("at_the_floor"), "p is at its floor, which tells the design's resolution and not how small p is"),
        (F.lit(True), F.concat(F.lit("influence: "), "influence", F.when(F.col("influence") == "FRAGILE", F.when(~F.col("survives"), ", the slope rests on its most exposed firms").otherwise(", its forms disagree in sign")).when(F.col("influence") == "CAUTION", F.concat(F.lit(", leverage is concentrated in "), F.format_string("%.0f", "effective_firms"), F.lit(" of "), F.col("nominal_firms").cast("string"), F.lit(" firms"))).otherwise(""))),
        (F.col("sign_test").isNull(), "the sign test was not run, and the pooled slope stands without it"),
        (F.col("sign_test").isNotNull(), F.concat(F.lit("sign test: "), "sign_test")),
    )
    return headline.select(F.explode(notes).alias("n")).select("n.place", "n.note")


def event_caveats(events: DataFrame) -> DataFrame:
    """(event_id, place, note): why events are set apart (event_id, risk, confounder, leak_note)."""
    high, leaked = F.lower(F.trim("risk")) == "high", F.coalesce(F.trim("leak_note") != "", F.lit(False))
    notes = _notes(
        (high, "anticipated: no effect on the day and an effect when the news was trailed look alike, so the estimate bounds the surprise that was left"),
        (high & leaked, F.concat(F.lit("curator: "), "leak_note")),
        (F.coalesce(F.trim("confounder") != "", F.lit(False)), F.concat(F.lit("confounded on its day by: "), "confounder")),
        (leaked & ~high, F.concat(F.lit("leaked: "), "leak_note", F.lit("; the effect is counted from the later date and is too small by an unknown amount"))),
    )
    return events.select("event_id", F.explode(notes).alias("n")).select("event_id", "n.place", "n.note")


def power_notes(rows: DataFrame, level: float = 0.05) -> DataFrame:
    """(event_id, unit_id, estimator, note): what a study's rows (placebos, p_floor, critical, mde, tau) could have found; rows without an effect say why there is none."""
    share = lambda c: F.format_string("%+.2f %%", F.col(c) * 100)
    cannot = F.concat(F.col("placebos").cast("string"), F.lit(" placebos allow no p under "), F.format_string("%.3f", "p_floor"), F.lit(": nothing could be significant"))
    could = F.concat(F.col("placebos").cast("string"), F.lit(" placebos: "), share("critical"), F.lit(" would be in the tail, "), share("mde"), F.lit(" would mostly be found, "), share("tau"), F.lit(" was seen"))
    note = F.when(F.col("tau").isNull(), F.concat("error_type", F.lit(": "), "message")).when(F.col("p_floor") > level, cannot).otherwise(could)
    return rows.select("event_id", "unit_id", "estimator", note.alias("note"))


EFFECTS = ("unit_id", "estimator", "tau", "ratio", "p_in_space", "p_in_time", "p_floor", "pre_rmspe", "pre_fit", "pretrend_violated", "loo_sign_stable", "loo_relative_shift", "effective_donors", "mde", "feasible")


def study_report(title: str, events: DataFrame, rows: DataFrame) -> str:
    """A study (``study.run_events``) as Markdown: clean events first, then those set apart with their caveats; refused if an effect has no placebos.

    ``events`` event_id, announced, time_known, direction, risk, confounder,
    leak_note: a curated dictionary, a section an event.
    """
    bare = rows.where("tau is not null and coalesce(placebos, 0) = 0").select("event_id", "unit_id", "estimator").limit(5).collect()
    if bare:
        raise MissingPlacebos(", ".join(str(tuple(r)) for r in bare))
    known = report_separately(events).orderBy("announced", "event_id").collect()
    caveats = {}
    for r in event_caveats(events).orderBy("event_id", "place").collect():
        caveats.setdefault(r["event_id"], []).append(r["note"])
    found = {r["event_id"] for r in rows.select("event_id").distinct().collect()}
    lines = [f"# {title}"]
    for heading, apart in (("Clean events", False), ("Events reported separately", True)):
        mine = [e for e in known if bool(e["flagged"]) == apart and e["event_id"] in found]
        lines += [f"## {heading}", f"_{len(mine)} events_"]
        for e in mine:
            own = rows.where(F.col("event_id") == e["event_id"])
            lines += [f"### {e['event_id']}", f"{e['announced']} ({'time known' if e['time_known'] else 'time not known'}), {e['direction']}, anticipation {e['risk']}"]
            lines += [f"> {note}" for note in caveats.get(e["event_id"], [])]
            lines += [markdown(own.where("tau is not null").select(*EFFECTS).orderBy("unit_id", "estimator")), markdown(power_notes(own).drop("event_id").orderBy("unit_id", "estimator"))]
    return "\n\n".join(lines) + "\n"


def dose_report(title: str, headline: DataFrame, path: DataFrame, leverage: DataFrame, sign: DataFrame | None = None) -> str:
    """A slope as Markdown: what could be detected first, then its figures, drop path, leverage, sign test and caveats."""
    row = headline.first()
    parts = [f"# {title}", f"An effect of {row['mde']:.6g} would be found four times in five.", markdown(headline), "Drop path", markdown(path.orderBy("k")), "Leverage", markdown(leverage)]
    if sign is not None:
        parts += ["Sign test", markdown(sign)]
    parts += ["\n".join(f"- {r['note']}" for r in dose_caveats(headline).orderBy("place").collect())]
    return "\n\n".join(parts) + "\n"

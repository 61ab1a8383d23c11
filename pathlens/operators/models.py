"""Transition and duration models as parameter tables.

Nothing is fitted on the driver or in one group's task: sufficient statistics are grouped
sums, and the expectation step is a join of aggregated censored durations with the
parameters, whose number is that of origins and groups.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import log_density, log_group_survival, log_interval, log_normal_survival, log_survival, safe_ratio
from ..sources.tables import shared_folder
from .journey import EXACT, INTERVAL, RIGHT
from .relational import exact_quantiles

DAY = 86400.0
SIGMA = (0.15, 4.5)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, cut from its lineage in the folder that the cluster shares."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def transition_frequencies(steps: DataFrame) -> DataFrame:
    """p(dest | origin) over observed steps, with pair and origin counts, entities, and the share of eligible steps with a known destination."""
    used = steps.filter("eligible")
    exact = used.filter(F.col("censoring") == EXACT)
    pairs = exact.groupBy("state", "dest").agg(F.count("*").alias("n"), F.countDistinct("entity").alias("entities"))
    origins = used.groupBy("state").agg(F.count_if(F.col("censoring") == EXACT).alias("origin_n"), F.countDistinct(F.when(F.col("censoring") == EXACT, F.col("entity"))).alias("origin_entities"), F.count("*").alias("origin_steps"))
    rows = pairs.join(origins, "state")
    return rows.withColumn("p", safe_ratio(F.col("n"), F.col("origin_n"))).withColumn("coverage", safe_ratio(F.col("origin_n"), F.col("origin_steps")))


def weighted_transitions(steps: DataFrame) -> DataFrame:
    """P by events and by entities (each entity's own shares, averaged over those with the origin), and their difference."""
    own = steps.filter(F.col("eligible") & (F.col("censoring") == EXACT)).groupBy("entity", "state", "dest").agg(F.count("*").alias("n"))
    own = own.withColumn("own_p", F.col("n") / F.sum("n").over(Window.partitionBy("entity", "state")))
    people = own.groupBy("state").agg(F.countDistinct("entity").alias("origin_entities"))
    pairs = own.groupBy("state", "dest").agg(F.sum("n").alias("n"), F.sum("own_p").alias("shares"))
    rows = pairs.join(people, "state").withColumn("p_events", F.col("n") / F.sum("n").over(Window.partitionBy("state"))).withColumn("p_entities", F.col("shares") / F.col("origin_entities"))
    return rows.withColumn("delta", F.col("p_entities") - F.col("p_events")).drop("shares")


def origin_profile(steps: DataFrame) -> DataFrame:
    """Of each origin the share of zero durations, self-transitions and right-censored steps."""
    return steps.filter("state is not null").groupBy("state").agg(
        F.count("*").alias("steps"), F.avg((F.col("dur_min") == 0).cast("double")).alias("zero_share"), F.count_if("self_transition").alias("self_transitions"), F.count_if(F.col("censoring") == RIGHT).alias("right_censored")
    )


def grouped_durations(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (kind, bounds) with their number: all that a likelihood needs."""
    return steps.filter("eligible").groupBy(*keys, "censoring", "dur_min", "dur_max").agg(F.count("*").alias("weight"))


def pooled_destinations(steps: DataFrame, keys: list[str], min_n: int = 100, min_entities: int = 15, most: int = 8, never_pooled: str = "sem_acao") -> DataFrame:
    """The group of each destination: its own if well supported (at most `most`), else the shared group 0; r is its share of the group."""
    support = steps.filter(F.col("eligible") & (F.col("censoring") == EXACT)).groupBy(*keys, "dest").agg(F.count("*").alias("n"), F.countDistinct("entity").alias("entities"))
    order = Window.partitionBy(*keys).orderBy(F.desc("enough"), F.desc("n"), F.desc("entities"), "dest")
    enough = ((F.col("n") >= min_n) & (F.col("entities") >= min_entities)) | (F.col("dest") == never_pooled)
    rows = support.withColumn("enough", enough).withColumn("_n", F.row_number().over(order))
    rows = rows.withColumn("grp", F.when(F.col("enough") & ((F.col("_n") <= most) | (F.col("dest") == never_pooled)), F.col("_n")).otherwise(0)).drop("enough", "_n")
    rows = rows.withColumn("r", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "grp")))
    return rows.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def _moments(prefix: str = "") -> list[Column]:
    x = F.log(F.col("dur_min") / DAY)
    return [F.sum("w").alias(f"{prefix}n"), F.sum(F.col("w") * x).alias(f"{prefix}s1"), F.sum(F.col("w") * x * x).alias(f"{prefix}s2")]


def _with_upper_bound(steps: DataFrame) -> DataFrame:
    """Steps without interval censoring need no `dur_max`."""
    return steps if "dur_max" in steps.columns else steps.withColumn("dur_max", F.lit(None).cast("double"))


def _tails(low: str, high: str) -> tuple[Column, Column]:
    """ln of the two tails whose difference is P(low < Z <= high) for standard normal Z, the larger one first; a null bound is infinite.

    They lie on the side where both are small, so that nothing cancels.
    """
    upper = F.coalesce(F.col(low) > 0, F.lit(False))
    near, far = F.when(upper, F.col(low)).otherwise(-F.col(high)), F.when(upper, F.col(high)).otherwise(-F.col(low))
    tail = lambda z, missing: F.when(z.isNull(), F.lit(missing)).otherwise(log_normal_survival(z))
    return tail(near, 0.0), tail(far, float("-inf"))


def fit_competing_lognormal(steps: DataFrame, groups: DataFrame, keys: list[str], *, weight: str | None = None, iterations: int = 30, alpha: float = 0.25, shrink: float = 2.0, every: int = 5, tolerance: float = 1e-6, timeout: float | None = None, silence: str = "sem_acao") -> DataFrame:
    """Pi, mu and sigma (of ln days) of each duration group, by expectation and maximisation with censoring.

    Exact steps enter as sums by group. Right-censored steps have no destination: aggregated to
    distinct durations, each is shared out over its origin's groups by pi times the chance of
    its bounds, with the moments of a normal cut off there. Interval-censored ones (dur_min <
    T <= dur_max; dur_min may be 0) are cut off on both sides; those that know their destination
    go to its group. mu is drawn to the origin's mean by `shrink` pseudo-observations, pi
    smoothed by `alpha`.

    With a `timeout` (seconds) the groups of destinations named `silence` begin there: a mass
    `atom` lies at the timeout itself, the rest is log-normal in the time after it, and
    censored steps take part in both. A group that never ends later is its atom alone.

    Iterations end when parameters move by less than `tolerance` between two cuts of their
    lineage, a row an origin and group each, or after `iterations`. Also whether sigma lies at a bound.
    """
    known = groups.withColumn("shift", F.when(F.col("dest").startswith(silence), F.lit(float(timeout))).otherwise(0.0) if timeout is not None else F.lit(0.0))
    steps = _with_upper_bound(steps)
    kept = F.col("eligible") & ((F.col("dur_min") > 0) | (F.col("censoring") == INTERVAL))
    rows = steps.filter(kept).withColumn("w", F.col(weight).cast("double") if weight else F.lit(1.0)).filter("w > 0")
    exact = rows.filter(F.col("censoring") == EXACT).join(known.select(*keys, "dest", "grp", "shift"), [*keys, "dest"])
    at = (F.col("shift") > 0) & (F.col("dur_min") - F.col("shift") <= 1.0)
    past = F.when(at, None).otherwise(F.log((F.col("dur_min") - F.col("shift")) / DAY))
    exact = exact.withColumn("x", past).withColumn("a", F.when(at, F.col("w")).otherwise(0.0)).withColumn("w", F.when(at, 0.0).otherwise(F.col("w")))
    sums = lambda prefix: [F.sum("w").alias(f"{prefix}n"), F.coalesce(F.sum(F.col("w") * F.col("x")), F.lit(0.0)).alias(f"{prefix}s1"), F.coalesce(F.sum(F.col("w") * F.col("x") * F.col("x")), F.lit(0.0)).alias(f"{prefix}s2")]
    stats = exact.groupBy(*keys, "grp", "shift").agg(*sums("e_"), F.sum("a").alias("e_a"))
    origin = exact.filter("shift = 0").groupBy(*keys).agg(*sums("o_"))
    stats = stats.join(origin, keys, "left").withColumn("size", F.count("*").over(Window.partitionBy(*keys)))
    own = F.when(F.col("e_n") > 0, F.col("e_s1") / F.col("e_n"))
    stats = checkpointed(stats.withColumn("o_mean", F.coalesce(F.when(F.col("shift") > 0, own).otherwise(F.col("o_s1") / F.col("o_n")), F.lit(0.0))).drop("o_n", "o_s1", "o_s2"))
    hidden = rows.filter(F.col("censoring").isin(RIGHT, INTERVAL))
    hidden = hidden.withColumn("dest", F.when(F.col("censoring") == INTERVAL, F.col("dest"))).withColumn("dur_max", F.when(F.col("censoring") == INTERVAL, F.col("dur_max")))
    hidden = hidden.join(known.select(*keys, "dest", F.col("grp").alias("own_grp")), [*keys, "dest"], "left").filter("dest is null or own_grp is not null")
    hidden = hidden.groupBy(*keys, "own_grp", "dur_min", "dur_max").agg(F.sum("w").alias("w"))
    hidden = checkpointed(hidden.join(stats.select(*keys).distinct(), keys, "left_semi"))

    low, high = SIGMA
    clamp = lambda v: F.least(F.greatest(F.sqrt(F.greatest(v, F.lit(0.0))), F.lit(low)), F.lit(high))

    def maximise(df: DataFrame) -> DataFrame:
        tail, mass = F.col("e_n") + F.col("c_n"), F.col("e_a") + F.col("c_a")
        mu = (F.col("e_s1") + F.col("c_s1") + shrink * F.col("o_mean")) / F.greatest(tail + shrink, F.lit(1e-300))
        df = df.withColumn("pi", (tail + mass + alpha) / (F.sum(tail + mass).over(Window.partitionBy(*keys)) + alpha * F.col("size"))).withColumn("mu", mu)
        second = (F.col("e_s2") + F.col("c_s2")) / tail - 2 * F.col("mu") * (F.col("e_s1") + F.col("c_s1")) / tail + F.col("mu") * F.col("mu")
        return df.withColumn("sigma", clamp(F.when(tail > 0, second).otherwise(0.0))).withColumn("atom", F.when(F.col("shift") > 0, mass / (tail + mass)).otherwise(0.0))

    names = ("c_n", "c_s1", "c_s2", "c_a")
    params = maximise(stats.select("*", *(F.lit(0.0).alias(c) for c in names)))
    params_cut = None
    for i in range(iterations):
        joined = hidden.join(params.select(*keys, "grp", "shift", "atom", "pi", "mu", "sigma"), keys).filter("own_grp is null or own_grp = grp")
        z = lambda c: F.when(F.col(c) > F.col("shift"), (F.log((F.col(c) - F.col("shift")) / DAY) - F.col("mu")) / F.col("sigma"))
        joined = joined.withColumn("z1", z("dur_min")).withColumn("z2", z("dur_max")).withColumn("none", F.coalesce(F.col("dur_max") <= F.col("shift"), F.lit(False)))
        larger, smaller = _tails("z1", "z2")
        joined = joined.withColumn("_larger", larger).withColumn("_smaller", smaller)
        joined = joined.withColumn("log_tail", F.col("_larger") + F.log(F.greatest(-F.expm1(F.col("_smaller") - F.col("_larger")), F.lit(1e-300))))
        joined = joined.withColumn("tail", F.when(F.col("none"), 0.0).otherwise(F.greatest(F.exp("log_tail"), F.lit(1e-300))))
        inside = (F.col("shift") > 0) & (F.col("dur_min") <= F.col("shift")) & F.coalesce(F.col("dur_max") >= F.col("shift"), F.lit(True))
        joined = joined.withColumn("mass", F.when(inside, F.col("atom")).otherwise(0.0)).withColumn("rest", (1 - F.col("atom")) * F.col("tail"))
        share = F.col("pi") * (F.col("mass") + F.col("rest"))
        joined = joined.withColumn("rho", F.col("w") * safe_ratio(share, F.sum(share).over(Window.partitionBy(*keys, "own_grp", "dur_min", "dur_max"))))
        joined = joined.withColumn("tail_rho", F.coalesce(F.col("rho") * safe_ratio(F.col("rest"), F.col("mass") + F.col("rest")), F.lit(0.0)))
        over = lambda c: F.when(F.col(c).isNull(), 0.0).otherwise(F.exp(-F.col(c) * F.col(c) / 2 - 0.9189385332046727 - F.col("log_tail")))
        joined = joined.withColumn("d1", over("z1")).withColumn("d2", over("z2"))
        slope = F.col("d1") - F.col("d2")
        first = F.col("mu") + F.col("sigma") * slope
        bend = 1 + F.coalesce(F.col("z1"), F.lit(0.0)) * F.col("d1") - F.coalesce(F.col("z2"), F.lit(0.0)) * F.col("d2")
        second = F.col("mu") * F.col("mu") + 2 * F.col("mu") * F.col("sigma") * slope + F.col("sigma") * F.col("sigma") * bend
        found = joined.groupBy(*keys, "grp").agg(F.sum("tail_rho").alias("c_n"), F.sum(F.col("tail_rho") * first).alias("c_s1"), F.sum(F.col("tail_rho") * second).alias("c_s2"), F.sum(F.coalesce(F.col("rho") - F.col("tail_rho"), F.lit(0.0))).alias("c_a"))
        params = maximise(stats.join(found, [*keys, "grp"], "left").fillna(0.0, list(names)))
        if (i + 1) % every == 0:
            before, params = params_cut, checkpointed(params)
            params_cut = params
            if before is not None:
                moving = ("pi", "mu", "sigma", "atom")
                old = before.select(*keys, "grp", *(F.col(c).alias(f"{c}_") for c in moving))
                moved = F.max(F.greatest(*(F.abs(F.col(c) - F.col(f"{c}_")) for c in moving)))
                if (params.join(old, [*keys, "grp"]).agg(moved).first()[0] or 0.0) < tolerance:
                    break
    at_bound = (F.col("atom") < 1) & ((F.col("sigma") <= low + 1e-9) | (F.col("sigma") >= high - 1e-9))
    return params.select(*keys, "grp", F.lit("lognormal").alias("family"), "shift", "atom", "pi", "mu", "sigma", (F.col("e_n") + F.col("e_a")).alias("exact_weight"), (F.col("c_n") + F.col("c_a")).alias("censored_weight"), at_bound.alias("at_bound"))


def log_likelihood(steps: DataFrame, groups: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """Of each origin the log-likelihood of exact, right- and interval-censored steps under the parameters."""
    rows = _with_upper_bound(steps).filter(F.col("eligible") & ((F.col("dur_min") > 0) | (F.col("censoring") == INTERVAL)))
    p = params.select(*keys, "grp", "pi", "mu", "sigma", *(F.col(c) if c in params.columns else F.lit(0.0).alias(c) for c in ("shift", "atom")))
    survival = lambda c: F.exp(log_group_survival(F.col(c), F.lit("lognormal"), F.col("mu"), F.col("sigma"), F.col("shift"), F.col("atom")))
    exact = rows.filter(F.col("censoring") == EXACT).join(groups.select(*keys, "dest", "grp", "r"), [*keys, "dest"]).join(p, [*keys, "grp"])
    at = (F.col("shift") > 0) & (F.col("dur_min") - F.col("shift") <= 1.0)
    density = F.log1p(-F.col("atom")) + log_density("lognormal", (F.col("dur_min") - F.col("shift")) / DAY, F.col("mu"), F.col("sigma"))
    exact = exact.select(*keys, (F.log(F.col("pi") * F.col("r")) + F.when(at, F.log("atom")).otherwise(density)).alias("ll"))
    hidden = rows.filter(F.col("censoring").isin(RIGHT, INTERVAL)).withColumn("dest", F.when(F.col("censoring") == INTERVAL, F.col("dest")))
    hidden = hidden.withColumn("dur_max", F.when(F.col("censoring") == INTERVAL, F.col("dur_max"))).groupBy(*keys, "dest", "dur_min", "dur_max").agg(F.count("*").alias("w"))
    hidden = hidden.join(groups.select(*keys, "dest", F.col("grp").alias("own_grp"), F.col("r").alias("own_r")), [*keys, "dest"], "left").filter("dest is null or own_grp is not null")
    # a timeout at the upper bound ends within the interval: its atom counts
    upper = F.when((F.col("shift") > 0) & (F.col("dur_max") == F.col("shift")), 1 - F.col("atom")).otherwise(survival("dur_max"))
    chance = F.col("pi") * F.coalesce("own_r", F.lit(1.0)) * (survival("dur_min") - F.when(F.col("dur_max").isNull(), 0.0).otherwise(upper))
    hidden = hidden.join(p, keys).filter("own_grp is null or own_grp = grp").groupBy(*keys, "dest", "dur_min", "dur_max", "w").agg(F.sum(chance).alias("s"))
    hidden = hidden.select(*keys, (F.col("w") * F.log(F.greatest("s", F.lit(1e-300)))).alias("ll"))
    return exact.unionByName(hidden).groupBy(*keys).agg(F.sum("ll").alias("log_likelihood"), F.count("*").alias("terms"))


def fit_timeout_atom(steps: DataFrame, keys: list[str], timeout: float, tolerance: float = 1.0, pure: float = 0.999) -> DataFrame:
    """Silences end at the timeout itself with some mass, else after it: atom, shifted lognormal tail, or both."""
    past = F.col("dur_min") - timeout
    at = F.abs(past) <= tolerance
    tail = F.when(~at & (past > 0), F.log(past / DAY))
    rows = steps.filter(F.col("eligible") & (F.col("censoring") == EXACT)).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(at).alias("at_timeout"), F.avg(tail).alias("mu"), F.stddev_pop(tail).alias("sd"))
    mass = F.col("at_timeout") / F.col("n")
    family = F.when(mass >= pure, "atom").when(mass <= 1 - pure, "shifted_lognormal").otherwise("mixture")
    sigma = F.when(family != "atom", F.least(F.greatest(F.col("sd"), F.lit(SIGMA[0])), F.lit(SIGMA[1])))
    return rows.select(*keys, "n", family.alias("family"), F.lit(float(timeout)).alias("shift"), mass.alias("atom"), F.when(family != "atom", F.col("mu")).alias("mu"), sigma.alias("sigma"))


def atom_survival(age: Column, shift: Column, atom: Column, mu: Column, sigma: Column) -> Column:
    """P(T >= age) of an atom at the shift and a shifted lognormal tail; at the atom itself all mass is still there."""
    return F.coalesce(F.exp(log_group_survival(age, F.lit("lognormal"), mu, sigma, shift, atom)), F.lit(0.0))


def fit_families(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Parameters of four duration families from moments of exact durations in days: a row a family.

    exponential: the mean; lognormal: moments of the log; Weibull and log-logistic: from the log's mean and deviation.
    """
    x = F.log(F.col("dur_min") / DAY)
    rows = steps.filter(F.col("eligible") & (F.col("censoring") == EXACT) & (F.col("dur_min") > 0)).groupBy(*keys)
    rows = rows.agg(F.count("*").alias("n"), F.avg(F.col("dur_min") / DAY).alias("mean"), F.avg(x).alias("m"), F.stddev_pop(x).alias("s")).filter("n >= 2 and s > 0")
    weibull_shape, logistic_shape = F.lit(math.pi / math.sqrt(6)) / F.col("s"), F.lit(math.pi / math.sqrt(3)) / F.col("s")
    family = lambda name, p1, p2, k: F.struct(F.lit(name).alias("family"), p1.alias("p1"), p2.alias("p2"), F.lit(k).alias("parameters"))
    options = F.array(
        family("exponential", F.lit(1.0), F.col("mean"), 1),
        family("weibull", weibull_shape, F.exp(F.col("m") + 0.5772156649015329 / weibull_shape), 2),
        family("loglogistic", logistic_shape, F.exp("m"), 2),
        family("lognormal", F.col("m"), F.col("s"), 2),
    )
    return rows.select(*keys, "n", F.explode(options).alias("f")).select(*keys, "n", "f.*")


#: Families in location and scale: z = (ln t - mu) / sigma. ln S, ln of the density of z, its slope and bend, slope and bend of ln S.
def _standard(family: str, z: Column, tail: Column) -> dict[str, Column]:
    """`tail` is ln P(Z > z) of a normal, which the log-normal alone needs: a column of its own, so that its polynomial is in the code once."""
    e = F.exp(F.least(z, F.lit(700.0)))
    if family in ("weibull", "exponential"):
        return {"log_s": -e, "log_g": z - e, "s1": 1 - e, "s2": -e, "r1": -e, "r2": -e}
    if family == "loglogistic":
        p = 1 / (1 + F.exp(F.least(-z, F.lit(700.0))))
        over = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
        return {"log_s": -over, "log_g": z - 2 * over, "s1": 1 - 2 * p, "s2": -2 * p * (1 - p), "r1": -p, "r2": -p * (1 - p)}
    log_g = -z * z / 2 - 0.9189385332046727
    hazard = F.exp(log_g - tail)
    return {"log_s": tail, "log_g": log_g, "s1": -z, "s2": F.lit(-1.0), "r1": -hazard, "r2": -hazard * (hazard - z)}


#: Parameters of each family; the exponential's sigma is 1.
FAMILIES = {"exponential": 1, "weibull": 2, "loglogistic": 2, "lognormal": 2}


def _terms(grouped: DataFrame, params: DataFrame, keys: list[str], family: str) -> DataFrame:
    """Of each key the log-likelihood of grouped durations and its first and second derivatives by mu and ln sigma, as sums."""
    rows = grouped.join(params.filter(F.col("family") == family).select(*keys, "mu", "ls"), keys)
    z = lambda c: F.when(F.col(c) > 0, (F.log(F.col(c) / DAY) - F.col("mu")) / F.exp("ls"))
    rows = rows.withColumn("z1", z("dur_min")).withColumn("z2", F.when(F.col("censoring") == INTERVAL, z("dur_max")))
    for c in ("z1", "z2"):
        rows = rows.withColumn(f"tail_{c}", log_normal_survival(F.col(c)) if family == "lognormal" else F.lit(None).cast("double"))
        of = F.struct(*(e.alias(n) for n, e in _standard(family, F.col(c), F.col(f"tail_{c}")).items()))
        rows = rows.select("*", F.when(F.col(c).isNotNull(), of).alias(f"f{c[1]}"))  # least and greatest would pass over a null
    sigma, exact, right = F.exp("ls"), F.col("censoring") == EXACT, F.col("censoring") == RIGHT
    one, bend = F.when(exact, F.col("f1.s1")).otherwise(F.col("f1.r1")), F.when(exact, F.col("f1.s2")).otherwise(F.col("f1.r2"))
    point = {
        "ll": F.when(exact, F.col("f1.log_g") - F.col("ls") - F.log(F.col("dur_min") / DAY)).otherwise(F.col("f1.log_s")),
        "m": -one / sigma,
        "l": -F.col("z1") * one - F.when(exact, 1.0).otherwise(0.0),
        "mm": bend / (sigma * sigma),
        "ml": (bend * F.col("z1") + one) / sigma,
        "ll2": F.col("z1") * one + F.col("z1") * F.col("z1") * bend,
    }
    # an interval: densities at its bounds over its chance; at 0 the lower one vanishes
    log_s1 = F.coalesce("f1.log_s", F.lit(0.0))
    rows = rows.withColumn("log_d", log_s1 + F.log(F.greatest(-F.expm1(F.col("f2.log_s") - log_s1), F.lit(1e-300))))
    rows = rows.withColumn("g1", F.coalesce(F.exp(F.col("f1.log_g") - F.col("log_d")), F.lit(0.0))).withColumn("g2", F.exp(F.col("f2.log_g") - F.col("log_d")))
    z1, t1 = F.coalesce("z1", F.lit(0.0)), F.coalesce("f1.s1", F.lit(0.0))
    z2, t2 = F.col("z2"), F.col("f2.s1")
    a, b = (F.col("g1") - F.col("g2")) / sigma, z1 * F.col("g1") - z2 * F.col("g2")
    between = {
        "ll": F.col("log_d"),
        "m": a,
        "l": b,
        "mm": -(F.col("g1") * t1 - F.col("g2") * t2) / (sigma * sigma) - a * a,
        "ml": -(F.col("g1") * (z1 * t1 + 1) - F.col("g2") * (z2 * t2 + 1)) / sigma - a * b,
        "ll2": -(F.col("g1") * z1 * (1 + z1 * t1) - F.col("g2") * z2 * (1 + z2 * t2)) - b * b,
    }
    sums = [F.sum(F.col("weight") * F.when(exact | right, point[c]).otherwise(between[c])).alias(c) for c in point]
    return rows.groupBy(*keys).agg(*sums, F.sum("weight").alias("n")).withColumn("family", F.lit(family))


def maximise_families(steps: DataFrame, keys: list[str], *, families: tuple[str, ...] = tuple(FAMILIES), rounds: int = 40, tolerance: float = 1e-7) -> DataFrame:
    """Maximum likelihood of duration families for exact, right- and interval-censored durations.

    Newton steps in mu and ln sigma from moments of the exact durations; a step after which the
    likelihood is lower is halved. What the rounds go over is one row a distinct duration and
    kind; each round is a sum of it by key and family, and only that sum's table goes on, cut
    from its lineage. Rounds end when no gradient exceeds `tolerance` a unit of weight. Columns:
    keys, family, p1, p2 (as in `log_survival`), parameters, n, log_likelihood, gradient (a unit
    of weight), aic, delta_aic. Keys without two different exact durations have no rows.
    """
    grouped = checkpointed(grouped_durations(steps.filter((F.col("dur_min") > 0) | (F.col("censoring") == INTERVAL)), keys).filter(F.col("censoring").isin(EXACT, RIGHT, INTERVAL)))
    x = F.log(F.col("dur_min") / DAY)
    start = grouped.filter((F.col("censoring") == EXACT) & (F.col("dur_min") > 0)).groupBy(*keys)
    start = start.agg(F.sum("weight").alias("k"), F.sum(F.col("weight") * x).alias("s1"), F.sum(F.col("weight") * x * x).alias("s2"), F.sum(F.col("weight") * F.col("dur_min") / DAY).alias("days"))
    mean, spread = F.col("s1") / F.col("k"), F.sqrt(F.greatest(F.col("s2") / F.col("k") - F.pow(F.col("s1") / F.col("k"), 2), F.lit(0.0)))
    start = start.filter("k >= 2").withColumn("mean", mean).withColumn("spread", spread).filter("spread > 1e-9")
    sigma = {"weibull": F.col("spread") * (math.sqrt(6) / math.pi), "loglogistic": F.col("spread") * (math.sqrt(3) / math.pi), "lognormal": F.col("spread"), "exponential": F.lit(1.0)}
    mu = {"weibull": F.col("mean") + 0.5772156649015329 * sigma["weibull"], "exponential": F.log(F.col("days") / F.col("k"))}
    first = [F.struct(F.lit(f).alias("family"), mu.get(f, F.col("mean")).alias("mu"), F.log(sigma[f]).alias("ls")) for f in families]
    params = start.select(*keys, F.explode(F.array(*first)).alias("f")).select(*keys, "f.*", *(F.lit(None).cast("double").alias(c) for c in ("base_mu", "base_ls", "base_ll")), F.lit(False).alias("done"))
    params = checkpointed(params)
    for _ in range(rounds):
        sums = reduce(DataFrame.unionByName, [_terms(grouped, params, keys, f) for f in families])
        at = params.select(*keys, "family", "mu", "ls", "base_mu", "base_ls", "base_ll").join(sums, [*keys, "family"])
        gradient = F.greatest(F.abs("m"), F.when(F.col("family") == "exponential", 0.0).otherwise(F.abs("l"))) / F.col("n")
        # while the last step lost likelihood, its half is tried from where it began
        lost = F.coalesce(F.isnan("ll") | (F.col("ll") < F.col("base_ll") - 1e-9 * F.abs("base_ll")), F.lit(False))
        at = at.withColumn("gradient", gradient).withColumn("lost", lost)
        fixed = F.col("family") == "exponential"
        det = F.col("mm") * F.col("ll2") - F.col("ml") * F.col("ml")
        concave = (F.col("mm") < 0) & (det > 0)
        down = lambda c: F.when(F.abs(c) < 2, c).otherwise(2 * F.signum(c))
        step_m = F.when(fixed, -F.col("m") / F.col("mm")).when(concave, -(F.col("ll2") * F.col("m") - F.col("ml") * F.col("l")) / det).otherwise(F.col("m") / F.greatest(F.abs("mm"), F.col("n") * 1e-3))
        step_l = F.when(fixed, 0.0).when(concave, -(F.col("mm") * F.col("l") - F.col("ml") * F.col("m")) / det).otherwise(F.col("l") / F.greatest(F.abs("ll2"), F.col("n") * 1e-3))
        moved = at.select(
            *keys, "family", "n", "gradient",
            F.when(F.col("lost"), (F.col("mu") + F.col("base_mu")) / 2).when(F.col("gradient") < tolerance, F.col("mu")).otherwise(F.col("mu") + down(step_m)).alias("mu"),
            F.when(F.col("lost"), (F.col("ls") + F.col("base_ls")) / 2).when(F.col("gradient") < tolerance, F.col("ls")).otherwise(F.col("ls") + down(step_l)).alias("ls"),
            *(F.when(F.col("lost"), F.col(f"base_{c}")).otherwise(F.col(c)).alias(f"base_{c}") for c in ("mu", "ls", "ll")),
            (~F.col("lost") & (F.col("gradient") < tolerance)).alias("done"),
        )
        params = checkpointed(moved)
        if params.filter("not done").isEmpty():
            break
    scale = F.exp("base_ls")
    p1 = F.when(F.col("family") == "lognormal", F.col("base_mu")).when(F.col("family") == "exponential", 1.0).otherwise(1 / scale)
    p2 = F.when(F.col("family") == "lognormal", scale).otherwise(F.exp("base_mu"))
    number = reduce(lambda c, f: F.when(F.col("family") == f, F.lit(FAMILIES[f])).otherwise(c), families, F.lit(None).cast("int"))
    out = params.select(*keys, "family", p1.alias("p1"), p2.alias("p2"), number.alias("parameters"), "n", F.col("base_ll").alias("log_likelihood"), "gradient", "done")
    out = out.withColumn("aic", 2 * F.col("parameters") - 2 * F.col("log_likelihood"))
    return out.withColumn("delta_aic", F.col("aic") - F.min("aic").over(Window.partitionBy(*keys)))


def compare_families(steps: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """Log-likelihood, AIC and its distance to the best of each family, and the holdout's mean negative log-likelihood by kind of censoring. An interval may begin at 0.

    Each family has a projection of its own, so that the generated code of each stays small.
    """
    used = steps.filter(F.col("eligible") & ((F.col("dur_min") > 0) | (F.col("censoring") == INTERVAL)))
    low, high, p1, p2 = F.col("dur_min") / DAY, F.col("dur_max") / DAY, F.col("p1"), F.col("p2")
    held = lambda kind: F.avg(F.when(F.col("holdout") & (F.col("censoring") == kind), -F.col("ll")))

    def judged(family: str) -> DataFrame:
        ll = F.when(F.col("censoring") == EXACT, log_density(family, low, p1, p2)).when(F.col("censoring") == INTERVAL, log_interval(family, low, high, p1, p2)).when(F.col("censoring") == RIGHT, log_survival(family, low, p1, p2))
        rows = used.join(fits.filter(F.col("family") == family).select(*keys, "family", "parameters", "p1", "p2"), keys).withColumn("ll", ll)
        return rows.groupBy(*keys, "family", "parameters").agg(F.sum(F.when(~F.col("holdout"), F.col("ll"))).alias("log_likelihood"), held(EXACT).alias("holdout_nll_exact"), held(RIGHT).alias("holdout_nll_right"))

    out = reduce(DataFrame.unionByName, map(judged, FAMILIES))
    out = out.withColumn("aic", 2 * F.col("parameters") - 2 * F.col("log_likelihood"))
    return out.withColumn("delta_aic", F.col("aic") - F.min("aic").over(Window.partitionBy(*keys)))


def horizon_exit(fits: DataFrame, ages: list[float], horizon: float) -> DataFrame:
    """Chance to leave within the horizon (seconds) given the elapsed time, by family."""
    rows = fits.withColumn("age", F.explode(F.array(*(F.lit(float(a)) for a in ages))))
    s = lambda t: log_survival(F.col("family"), t / DAY, F.col("p1"), F.col("p2"))
    return rows.withColumn("exit", -F.expm1(s(F.col("age") + horizon) - s(F.col("age"))))


def context_support(steps: DataFrame, min_n: int = 80, min_entities: int = 20) -> DataFrame:
    """Of each origin and context the support and what kind of model it can have."""
    from .journey import BASE, NO_MEMORY

    rows = steps.filter(F.col("eligible") & ~F.col("holdout")).groupBy("state", "context").agg(F.count("*").alias("n"), F.countDistinct("entity").alias("entities"))
    status = F.when(F.col("context") == BASE, "origem").when(F.col("context") == NO_MEMORY, "sem_memoria").when((F.col("n") >= min_n) & (F.col("entities") >= min_entities), "candidato").otherwise("raro")
    return rows.withColumn("support_status", status)


def shrunk_contexts(steps: DataFrame, parent: DataFrame, supported: DataFrame, strength: float = 20.0) -> DataFrame:
    """Transition probabilities of supported (origin, context) pairs, drawn to the origin's by a prior of so many observations."""
    exact = steps.filter(F.col("eligible") & ~F.col("holdout") & (F.col("censoring") == EXACT)).join(supported.select("state", "context"), ["state", "context"], "left_semi")
    own = exact.groupBy("state", "context", "dest").agg(F.count("*").alias("n"))
    totals = own.groupBy("state", "context").agg(F.sum("n").alias("total"))
    grid = totals.join(parent.select("state", "dest", "p"), "state")
    rows = grid.join(own, ["state", "context", "dest"], "left").fillna(0, ["n"])
    return rows.select("state", "context", "dest", "n", ((F.col("n") + strength * F.col("p")) / (F.col("total") + strength)).alias("p"))


def shrunk_durations(steps: DataFrame, groups: DataFrame, parent: DataFrame, supported: DataFrame, strength: float = 20.0) -> DataFrame:
    """Mu and ln sigma of (origin, context, group), drawn to the origin's parameters by a prior of so many observations."""
    exact = steps.filter(F.col("eligible") & ~F.col("holdout") & (F.col("censoring") == EXACT)).join(supported.select("state", "context"), ["state", "context"], "left_semi").join(groups.select("state", "dest", "grp"), ["state", "dest"])
    own = exact.withColumn("w", F.lit(1.0)).groupBy("state", "context", "grp").agg(*_moments())
    rows = own.join(parent.select("state", "grp", F.col("mu").alias("mu0"), F.col("sigma").alias("sigma0")), ["state", "grp"])
    n, mean = F.col("n"), F.col("s1") / F.col("n")
    deviation = F.greatest(F.sqrt(F.greatest(F.col("s2") / n - mean * mean, F.lit(0.0))), F.lit(SIGMA[0]))
    mix = lambda own, prior: (n * own + strength * prior) / (n + strength)
    return rows.select("state", "context", "grp", "n", mix(mean, F.col("mu0")).alias("mu"), F.exp(mix(F.log(deviation), F.log("sigma0"))).alias("sigma"))


def recombined(context_dests: DataFrame, parent_dests: DataFrame, parent_params: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The context's probabilities with the origin's duration curves: pi of a group is what its destinations have in the context."""
    dests = context_dests.join(parent_dests.select("state", "dest", "grp"), ["state", "dest"])
    pi = dests.groupBy("state", "context", "grp").agg(F.sum("p").alias("pi"))
    dests = dests.join(pi, ["state", "context", "grp"]).withColumn("r", safe_ratio(F.col("p"), F.col("pi"))).drop("pi")
    return dests, pi.join(parent_params.drop("pi"), ["state", "grp"])


def at_bounds(params: DataFrame, parent: DataFrame | None, keys: list[str], bounds: dict[str, tuple[float, float]], tolerance: float = 1e-6) -> DataFrame:
    """Parameters at a bound: which, its value, the side, and the distance to the parent's."""
    stacked = F.explode(F.array(*(F.struct(F.lit(n).alias("parameter"), F.col(n).cast("double").alias("value"), F.lit(float(lo)).alias("low"), F.lit(float(hi)).alias("high")) for n, (lo, hi) in bounds.items())))
    rows = params.select(*keys, "grp", stacked.alias("b")).select(*keys, "grp", "b.*")
    side = F.when(F.abs(F.col("value") - F.col("low")) < tolerance, "low").when(F.abs(F.col("value") - F.col("high")) < tolerance, "high")
    rows = rows.withColumn("side", side).filter("side is not null").drop("low", "high")
    if parent is None:
        return rows.withColumn("parent_delta", F.lit(None).cast("double"))
    above = parent.select("state", "grp", F.explode(F.array(*(F.struct(F.lit(n).alias("parameter"), F.col(n).cast("double").alias("parent_value")) for n in bounds))).alias("b")).select("state", "grp", "b.*")
    return rows.join(above, ["state", "grp", "parameter"], "left").withColumn("parent_delta", F.col("value") - F.col("parent_value")).drop("parent_value")


def duration_profile(steps: DataFrame, keys: list[str], timeout: float) -> DataFrame:
    """Modal time and its share, share at the timeout, exact quantiles, deviation of the log, distinct times."""
    rows = steps.filter(F.col("eligible") & (F.col("censoring") == EXACT) & (F.col("dur_min") > 0))
    times = rows.groupBy(*keys, "dur_min").agg(F.count("*").alias("k"))
    modal = times.groupBy(*keys).agg(F.max_by("dur_min", F.struct("k", -F.col("dur_min"))).alias("modal_time"), F.max("k").alias("modal_n"), F.count("*").alias("distinct_times"))
    stats = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.abs(F.col("dur_min") - timeout) < 1).cast("double")).alias("share_at_timeout"), F.stddev_pop(F.log("dur_min")).alias("sd_log"))
    stats = stats.join(exact_quantiles(rows, "dur_min", [0.05, 0.5, 0.95], tuple(keys)), keys)
    return stats.join(modal, keys).select(*keys, "n", "modal_time", (F.col("modal_n") / F.col("n")).alias("modal_share"), "share_at_timeout", F.col("q")[0].alias("q05"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q95"), "sd_log", "distinct_times")


def tail_support(steps: DataFrame, keys: list[str], ages: list[float]) -> DataFrame:
    """What is at risk beyond each age: steps, entities, exact, censored, weight."""
    rows = steps.filter("eligible").withColumn("age", F.explode(F.array(*(F.lit(float(a)) for a in ages)))).filter(F.col("dur_min") > F.col("age"))
    return rows.groupBy(*keys, "age").agg(F.count("*").alias("at_risk"), F.countDistinct("entity").alias("entities"), F.count_if(F.col("censoring") == EXACT).alias("exact"), F.count_if(F.col("censoring") == RIGHT).alias("censored"))


def parent_and_child(steps: DataFrame, supported: DataFrame) -> DataFrame:
    """Each training row for its origin's model, and again for its context's if that is fitted."""
    from .journey import BASE

    used = steps.filter(F.col("eligible") & ~F.col("holdout"))
    child = used.join(supported.select("state", "context"), ["state", "context"], "left_semi").withColumn("model_context", F.col("context"))
    return used.withColumn("model_context", F.lit(BASE)).unionByName(child)


def failure_summary(models: DataFrame, holdout: DataFrame) -> DataFrame:
    """Unfitted origins by cause, with the holdout steps and entities they touch."""
    hit = holdout.groupBy("state").agg(F.count("*").alias("steps"), F.countDistinct("entity").alias("entities"))
    rows = models.filter("fit_status <> 'ajustado'").select("state", "fit_status").join(hit, "state", "left").fillna(0, ["steps", "entities"])
    return rows.groupBy("fit_status").agg(F.count("*").alias("origins"), F.sum("steps").alias("holdout_steps"), F.sum("entities").alias("holdout_entities"))


def fit_status(steps: DataFrame, min_n: int = 80, min_entities: int = 20) -> DataFrame:
    """Of each origin whether its support suffices for a model."""
    rows = steps.filter("eligible").groupBy("state").agg(F.count_if(F.col("censoring") == EXACT).alias("n"), F.countDistinct(F.when(F.col("censoring") == EXACT, F.col("entity"))).alias("entities"))
    enough = (F.col("n") >= min_n) & (F.col("entities") >= min_entities)
    # The names that results bear.
    return rows.withColumn("fit_status", F.when(F.col("n") == 0, "sem_destino_exato").when(enough, "ajustado").otherwise("suporte_insuficiente"))


def sample_support(sample: DataFrame, whole: DataFrame) -> DataFrame:
    """Of each origin the sample's steps and entities beside the whole's."""
    count = lambda df, name: df.filter("eligible").groupBy("state").agg(F.count("*").alias(f"{name}_steps"), F.countDistinct("entity").alias(f"{name}_entities"))
    rows = count(whole, "whole").join(count(sample, "sample"), "state", "left").fillna(0, ["sample_steps", "sample_entities"])
    return rows.withColumn("share", safe_ratio(F.col("sample_steps"), F.col("whole_steps")))


def frequency_baseline(labels: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """Of each `by` (age) the outcome distribution over resolved training labels, every entity with the total weight 1.

    `targets` (action) is a small table; targets never seen get 0. Ranked by probability, then name; `__none__` is "no target".
    """
    resolved = labels.filter("label_status <> 'CENSURADO_ANTES_HORIZONTE'").withColumn("outcome", F.coalesce("action", F.lit("__none__")))
    weight = 1 / F.count("*").over(Window.partitionBy(*by, "entity"))
    sums = resolved.withColumn("w", weight).groupBy(*by, "outcome").agg(F.sum("w").alias("w"), F.count("*").alias("cases"))
    totals = sums.groupBy(*by).agg(F.sum("w").alias("total"))
    outcomes = targets.select(F.col("action").alias("outcome")).union(targets.sparkSession.createDataFrame([("__none__",)], "outcome string"))
    grid = totals.crossJoin(F.broadcast(outcomes))  # outcomes are the configured targets
    rows = grid.join(sums, [*by, "outcome"], "left").fillna(0, ["w", "cases"]).withColumn("p", safe_ratio(F.col("w"), F.col("total"))).drop("w", "total")
    place = F.row_number().over(Window.partitionBy(*by).orderBy((F.col("outcome") == "__none__").cast("int"), F.desc("p"), "outcome"))
    return rows.withColumn("rank", F.when(F.col("outcome") != "__none__", place))

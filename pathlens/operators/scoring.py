"""Age-conditioned next states and multi-step propagation.

Propagation works on states, not on entities: kernels of an origin are made once by joins of
edge tables and then joined to the entities that are there. An edge table has src, dst, p;
what a source's probabilities lack to 1 is lost mass ("no model").
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import log_group_survival, safe_ratio
from .journey import BASE, NO_MEMORY
from .models import checkpointed
from .relational import top_k


def _curves(groups: DataFrame, keys: list[str]) -> DataFrame:
    """The columns of duration groups that scores use; groups without an atom begin at 0."""
    zero = [F.col(c) if c in groups.columns else F.lit(0.0).alias(c) for c in ("shift", "atom")]
    return groups.select(*keys, "grp", "family", "p1", "p2", "pi", *zero)


def _log_survival_at(age: Column) -> Column:
    """ln P(T >= age), in seconds, of a row of `_curves`: p1 and p2 (or mu and sigma) as the family has them."""
    return log_group_survival(age, F.col("family"), F.col("p1"), F.col("p2"), F.col("shift"), F.col("atom"))


def group_weights(cases: DataFrame, groups: DataFrame, keys: list[str], case: list[str]) -> DataFrame:
    """(case, keys, age, grp, weight): pi S(age) of each duration group, normalised in log space over a case's groups.

    A group whose atom is all that it has is gone after it; a case beyond all its groups has no rows.
    """
    rows = cases.join(_curves(groups, keys), keys).withColumn("log_m", F.log("pi") + _log_survival_at(F.col("age"))).filter(F.col("log_m") > float("-inf"))
    whole = Window.partitionBy(*case)
    rows = rows.withColumn("m", F.exp(F.col("log_m") - F.max("log_m").over(whole)))
    return rows.withColumn("weight", F.col("m") / F.sum("m").over(whole)).select(*case, *keys, "age", "grp", "weight")


def conditioned(cases: DataFrame, groups: DataFrame, dests: DataFrame, keys: list[str], case: list[str]) -> DataFrame:
    """q(dest | age) of every case: group weights times r.

    cases: case columns, keys, age (seconds); groups: keys, grp, family, p1, p2, pi, and shift and
    atom where groups begin later; dests: keys, dest, grp, r, p.
    """
    rows = group_weights(cases, groups, keys, case)
    return rows.join(dests.select(*keys, "dest", "grp", "r", "p"), [*keys, "grp"]).withColumn("q", F.col("weight") * F.col("r"))


def horizon(cases: DataFrame, groups: DataFrame, dests: DataFrame, keys: list[str], case: list[str], seconds: float) -> DataFrame:
    """Chance that the next state is dest within the horizon, and that there is no exit within it."""
    rows = cases.join(_curves(groups, keys), keys)
    rows = rows.withColumn("now", F.col("pi") * F.exp(_log_survival_at(F.col("age")))).withColumn("later", F.col("pi") * F.exp(_log_survival_at(F.col("age") + seconds)))
    whole = Window.partitionBy(*case)
    total = F.sum("now").over(whole)
    rows = rows.withColumn("exit_weight", safe_ratio(F.col("now") - F.col("later"), total)).withColumn("no_exit", safe_ratio(F.sum("later").over(whole), total))
    return rows.select(*case, *keys, "grp", "exit_weight", "no_exit").join(dests.select(*keys, "dest", "grp", "r"), [*keys, "grp"]).select(*case, "dest", (F.col("exit_weight") * F.col("r")).alias("within"), "no_exit")


def time_status(rows: DataFrame, oldest: DataFrame, keys: list[str]) -> DataFrame:
    """Whether an age lies beyond the longest duration seen of its model, and how its group is timed."""
    out = rows.join(oldest, keys, "left").withColumn("extrapolated", F.coalesce(F.col("age") > F.col("max_duration"), F.lit(True)))
    status = F.when(F.col("max_duration").isNull(), "sem_modelo").when(F.col("extrapolated"), "fora_do_suporte").when(F.col("grp") == 0, "grupo_comum").otherwise("grupo_proprio")
    return out.withColumn("time_status", status)


def temporal_variation(q: DataFrame, case: list[str]) -> DataFrame:
    """Total variation between q(age) and p."""
    return q.groupBy(*case).agg((F.sum(F.abs(F.col("q") - F.col("p"))) * 0.5).alias("variation"))


def routed(cases: DataFrame, supported: DataFrame, origins: DataFrame, fitted_contexts: DataFrame) -> DataFrame:
    """The context whose model scores a case, or the origin's, with the reason.

    supported: state, context, support_status; origins: state; fitted_contexts: state, context.
    """
    rows = cases.join(supported.select("state", "context", "support_status"), ["state", "context"], "left")
    rows = rows.join(origins.select("state", F.lit(True).alias("_origin")), "state", "left").join(fitted_contexts.select("state", "context", F.lit(True).alias("_fitted")), ["state", "context"], "left")
    # The names that results bear.
    route = (
        F.when(F.col("_fitted") & F.col("_origin"), "contexto")
        .when(F.col("_origin").isNull(), "sem_modelo_origem")
        .when(F.col("context") == BASE, "origem_nao_tecnica")
        .when(F.col("context") == NO_MEMORY, "sem_memoria")
        .when(F.col("support_status").isNull(), "contexto_nao_visto")
        .when(F.col("support_status") == "raro", "contexto_raro")
        .otherwise("ajuste_filho_falhou")
    )
    rows = rows.withColumn("route", route)
    return rows.withColumn("model_context", F.when(F.col("route") == "contexto", F.col("context")).when(F.col("route") != "sem_modelo_origem", F.lit(BASE))).drop("_origin", "_fitted", "support_status")


def next_states(current: DataFrame, probabilities: DataFrame, k: int = 5) -> DataFrame:
    """The k likeliest next states of every entity; those without prediction stay with a null rank and a status.

    The k best of each origin are chosen first, so that no more than k rows an entity come out of the join.
    """
    best = top_k(probabilities.select("state", "dest", "p", "n", "origin_n"), ["state"], [F.desc("p"), F.asc("dest")], k)
    rows = current.join(best, "state", "left")
    status = F.when(F.col("input_status") != "ok", F.col("input_status")).when(F.col("rank").isNull(), "sem_modelo").otherwise("ok")
    return rows.withColumn("prediction_status", status)


def step_distribution(edges: DataFrame, steps: int) -> DataFrame:
    """(start, step, node, mass) after exactly 1..steps transitions, and the mass lost so far."""
    here = edges.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.col("p").alias("mass"))
    here = here.groupBy("start", "node").agg(F.sum("mass").alias("mass"))
    out = [here.withColumn("step", F.lit(1))]
    for step in range(2, steps + 1):
        here = here.join(edges, here.node == edges.src).groupBy("start", F.col("dst").alias("node")).agg(F.sum(F.col("mass") * F.col("p")).alias("mass"))
        out.append(here.withColumn("step", F.lit(step)))
    rows = reduce(DataFrame.unionByName, out)
    return rows.withColumn("lost", 1 - F.sum("mass").over(Window.partitionBy("start", "step")))


def first_passage(edges: DataFrame, is_target: Column, steps: int) -> DataFrame:
    """(start, reached, surviving, lost): chance that a target is entered within so many transitions.

    `is_target` speaks of the column dst.
    """
    marked = edges.withColumn("hit", is_target)
    here, hits = None, []
    for step in range(1, steps + 1):
        moved = marked.select(F.col("src").alias("start"), "dst", "p", "hit") if here is None else here.join(marked, here.node == marked.src).select("start", "dst", (F.col("mass") * F.col("p")).alias("p"), "hit")
        hits.append(moved.filter("hit").groupBy("start").agg(F.sum("p").alias("mass")).withColumn("step", F.lit(step)))
        here = moved.filter(~F.col("hit")).groupBy("start", F.col("dst").alias("node")).agg(F.sum("p").alias("mass"))
    reached = reduce(DataFrame.unionByName, hits).groupBy("start").agg(F.sum("mass").alias("reached"))
    alive = here.groupBy("start").agg(F.sum("mass").alias("surviving"))
    starts = edges.select(F.col("src").alias("start")).distinct()
    rows = starts.join(reached, "start", "left").join(alive, "start", "left").fillna(0.0, ["reached", "surviving"])
    return rows.withColumn("lost", 1 - F.col("reached") - F.col("surviving"))


def first_passage_by_age(first_step: DataFrame, edges: DataFrame, is_target: Column, steps: int, case: list[str]) -> DataFrame:
    """(case, reached, surviving, lost) within so many transitions, of which the first knows the case's age.

    first_step: case, dest, q (see `conditioned`); `is_target` speaks of the column dst. Later
    transitions start on arrival, at age 0, and are walked once a state. Mass that comes to a
    state without model is lost, as is what q lacks to 1; at the last transition it still survives.
    """
    named = first_step.select(*case, F.col("dest").alias("dst"), "q").withColumn("hit", is_target)
    if steps > 1:
        later = first_passage(edges, is_target, steps - 1).select(F.col("start").alias("dst"), F.col("reached").alias("on"), F.col("surviving").alias("left"))
        named = named.join(later, "dst", "left")
    else:
        named = named.withColumn("on", F.lit(0.0)).withColumn("left", F.lit(1.0))
    gained = F.when(F.col("hit"), F.col("q")).otherwise(F.col("q") * F.coalesce("on", F.lit(0.0)))
    kept = F.when(F.col("hit"), 0.0).otherwise(F.col("q") * F.coalesce("left", F.lit(0.0)))
    out = named.groupBy(*case).agg(F.sum(gained).alias("reached"), F.sum(kept).alias("surviving"))
    return out.withColumn("lost", 1 - F.col("reached") - F.col("surviving"))


def first_action(edges: DataFrame, actions: DataFrame, steps: int, suppress: DataFrame | None = None) -> DataFrame:
    """(start, action, score, best_step) of the first relevant action within so many transitions.

    actions: dst, action, for the states that are targets. `suppress` (start, action) names the
    action that doesn't count for a start over the whole horizon: the walk passes through it.
    """
    marked = edges.join(actions, "dst", "left")
    if suppress is not None:
        suppress = suppress.select("start", F.col("action").alias("own"))
    here, hits = None, []
    for step in range(1, steps + 1):
        moved = marked.select(F.col("src").alias("start"), "dst", "p", "action") if here is None else here.join(marked, here.node == marked.src).select("start", "dst", (F.col("mass") * F.col("p")).alias("p"), "action")
        if suppress is not None:
            moved = moved.join(suppress, "start", "left").withColumn("action", F.when(~F.col("action").eqNullSafe(F.col("own")), F.col("action"))).drop("own")
        hits.append(moved.filter("action is not null").groupBy("start", "action").agg(F.sum("p").alias("mass")).withColumn("step", F.lit(step)))
        here = moved.filter("action is null").groupBy("start", F.col("dst").alias("node")).agg(F.sum("p").alias("mass"))
    rows = reduce(DataFrame.unionByName, hits)
    return rows.groupBy("start", "action").agg(F.sum("mass").alias("score"), F.max_by("step", F.struct("mass", -F.col("step"))).alias("best_step"))


def first_action_by_age(first_step: DataFrame, edges: DataFrame, actions: DataFrame, steps: int, case: list[str]) -> DataFrame:
    """(case, action, score) of the first relevant action within so many transitions, of which the first knows the case's age.

    first_step: case, dest, q (see `conditioned`); later steps start on arrival, at age 0, and are
    walked once for each state; cases only look up their destinations' scores. A case without
    destinations has no rows.
    """
    named = first_step.select(*case, "dest", "q").join(actions.select(F.col("dst").alias("dest"), "action"), "dest", "left")
    scores = named.filter("action is not null").select(*case, "action", F.col("q").alias("score"))
    if steps > 1:
        later = first_action(edges, actions, steps - 1).select(F.col("start").alias("dest"), F.col("action").alias("later"), F.col("score").alias("s"))
        onward = named.filter("action is null").join(later, "dest")
        scores = scores.union(onward.select(*case, F.col("later").alias("action"), (F.col("q") * F.col("s")).alias("score")))
    return scores.groupBy(*case, "action").agg(F.sum("score").alias("score"))


def closed_nodes(edges: DataFrame, internal: Column) -> DataFrame:
    """Nodes that internal edges never let out of their macro: backwards from those that can leave, to the fixed point."""
    marked = edges.withColumn("internal", internal)
    totals = edges.groupBy("src").agg(F.sum("p").alias("total"))
    leaky = marked.filter(~F.col("internal")).select(F.col("src").alias("node")).union(totals.filter("total < 1 - 1e-9").select("src")).union(edges.select("dst").join(totals, F.col("dst") == F.col("src"), "left_anti"))
    free = checkpointed(leaky.distinct())
    inner = marked.filter("internal").select("src", "dst")
    while True:
        more = inner.join(free, inner.dst == free.node, "left_semi").select(F.col("src").alias("node")).distinct().join(free, "node", "left_anti")
        more = checkpointed(more)
        if more.isEmpty():
            break
        free = checkpointed(free.union(more))
    return edges.select(F.col("src").alias("node")).distinct().join(free, "node", "left_anti")


def macro_jumps(edges: DataFrame, macros: DataFrame, tolerance: float = 1e-9, most: int = 60) -> DataFrame:
    """(src, dst, p, kind) of the first state in another macro action; steps within a macro cost nothing.

    Internal steps are squared, so that each round walks twice as many, until less than
    `tolerance` of any start is still on its way. kind: `jump`; `lost` for mass without model;
    `retained` for what comes into closed nodes (L15), which nothing leaves; `unresolved` for
    what is still on its way after `most` rounds or leads to a node without macro.
    """
    side = lambda name: macros.select(F.col("node").alias(name), F.col("macro").alias(f"{name}_macro"))
    same = F.coalesce(F.col("src_macro") == F.col("dst_macro"), F.lit(False))
    named = checkpointed(edges.join(side("src"), "src", "left").join(side("dst"), "dst", "left").select("src", "dst", "p", "src_macro", "dst_macro"))
    nodes = checkpointed(named.select("src").distinct())
    named = named.filter("p > 0")
    closed = checkpointed(closed_nodes(named, same))
    leaving = named.join(closed, named.src == closed.node, "left_anti")
    inner = leaving.filter(same)
    into = inner.join(closed, inner.dst == closed.node, "left_semi")
    steps = inner.join(closed, inner.dst == closed.node, "left_anti").groupBy("src", "dst").agg(F.sum("p").alias("p"))
    nowhere = F.lit(None).cast("string").alias("dst")
    totals = named.groupBy("src").agg(F.sum("p").alias("total"))
    known = nodes.union(inner.select("dst")).distinct().join(totals, "src", "left").join(closed, F.col("src") == F.col("node"), "left_anti")
    parts = [
        leaving.filter("src_macro <> dst_macro").select("src", "dst", F.lit("jump").alias("kind"), "p"),
        into.select("src", nowhere, F.lit("retained").alias("kind"), "p"),
        nodes.join(closed, F.col("src") == F.col("node"), "left_semi").select("src", nowhere, F.lit("retained").alias("kind"), F.lit(1.0).alias("p")),
        known.select("src", nowhere, F.lit("lost").alias("kind"), F.greatest(1 - F.coalesce("total", F.lit(0.0)), F.lit(0.0)).alias("p")),
    ]
    summed = lambda df: checkpointed(df.filter("p > 0").groupBy("src", "dst", "kind").agg(F.sum("p").alias("p")))
    landed, steps = summed(reduce(DataFrame.union, parts)), checkpointed(steps)
    for _ in range(most):
        onward = steps.select("src", F.col("dst").alias("via"), F.col("p").alias("q"))
        after = landed.select(F.col("src").alias("via"), "dst", "kind", "p")
        landed = summed(landed.union(onward.join(after, "via").select("src", "dst", "kind", (F.col("q") * F.col("p")).alias("p"))))
        after = steps.select(F.col("src").alias("via"), "dst", "p")
        steps = checkpointed(onward.join(after, "via").groupBy("src", "dst").agg(F.sum(F.col("q") * F.col("p")).alias("p")).filter("p > 0"))
        if (steps.groupBy("src").agg(F.sum("p").alias("p")).agg(F.max("p")).first()[0] or 0.0) < tolerance:
            break
    landed = landed.join(nodes, "src", "left_semi").select("src", "dst", "p", "kind")
    left = nodes.join(landed.groupBy("src").agg(F.sum("p").alias("done")), "src", "left")
    left = left.select("src", nowhere, F.greatest(1 - F.coalesce("done", F.lit(0.0)), F.lit(0.0)).alias("p"), F.lit("unresolved").alias("kind")).filter(F.col("p") > tolerance)
    return checkpointed(landed.union(left))


def macro_scores(first_step: DataFrame, jumps: DataFrame, macros: DataFrame, case: list[str]) -> DataFrame:
    """The first different macro action of a case from its age-conditioned next states.

    first_step: case, state, dest, q. A destination in the state's own macro goes on by the jumps.
    """
    side = lambda name: macros.select(F.col("node").alias(name), F.col("macro").alias(f"{name}_macro"))
    rows = first_step.join(side("state"), "state").join(side("dest"), "dest", "left")
    direct = rows.filter("dest_macro <> state_macro").select(*case, F.col("dest_macro").alias("macro"), "q")
    onward = rows.filter("dest_macro = state_macro").join(jumps.filter("kind = 'jump'").select(F.col("src").alias("dest"), "dst", "p"), "dest").join(side("dst"), "dst").select(*case, F.col("dst_macro").alias("macro"), (F.col("q") * F.col("p")).alias("q"))
    scores = direct.union(onward).groupBy(*case, "macro").agg(F.sum("q").alias("score"))
    return scores.withColumn("share", safe_ratio(F.col("score"), F.sum("score").over(Window.partitionBy(*case))))


def passage_by_step(jumps: DataFrame, macros: DataFrame, targets: list[str], k: int, terminals: DataFrame | None = None) -> DataFrame:
    """(src, kind, action, change, score): what happens at each of k macro changes, and what is left after it.

    kind `target`: an action, taken on arrival; `no_model`, `retained`, `unresolved` (see
    macro_jumps; a node without outgoing edges has no model for what would come next);
    `terminal`: arrival at one of `terminals` (node), which nothing leaves; `alive`: what goes
    on after the change. With `alive` of the last change a start's rows, but for `alive`, add up to 1.

    The jumps, a closure of all steps within macros, are one table that all changes share; each
    change is one join with it, summed by start and node and written.
    """
    side = macros.select(F.col("node").alias("dst"), F.col("macro").alias("dst_macro"))
    moves = jumps.filter("kind = 'jump'").join(side, "dst", "left").withColumn("action", F.when(F.col("dst_macro").isin(targets), F.col("dst_macro"))).select("src", "dst", "p", "action")
    if terminals is not None:
        moves = moves.join(terminals.select(F.col("node").alias("dst"), F.lit(True).alias("ends")), "dst", "left")
    moves = checkpointed(moves.select("src", "dst", "p", "action", (F.coalesce("ends", F.lit(False)) if terminals is not None else F.lit(False)).alias("ends")))
    residual = jumps.filter("kind <> 'jump'").select("src", F.when(F.col("kind") == "lost", "no_model").otherwise(F.col("kind")).alias("kind"), "p")
    known = checkpointed(jumps.select(F.col("src").alias("node")).distinct())
    if terminals is not None:
        known = known.join(terminals, "node", "left_anti")
    here = known.select(F.col("node").alias("start"), "node", F.lit(1.0).alias("mass"))
    parts = []
    for h in range(1, k + 1):
        at = lambda df, kind, h=h: df.groupBy("start", kind.alias("kind"), "action").agg(F.sum("mass").alias("score")).withColumn("change", F.lit(h))
        none = F.lit(None).cast("string").alias("action")
        stay = here.join(residual, here.node == residual.src).select("start", "kind", none, (F.col("mass") * F.col("p")).alias("mass"))
        parts.append(at(stay, F.col("kind")))
        if h > 1:
            parts.append(at(here.join(known, "node", "left_anti").select("start", none, "mass"), F.lit("no_model")))
        moved = here.join(moves, here.node == moves.src).groupBy("start", "dst", "action", "ends").agg(F.sum(F.col("mass") * F.col("p")).alias("mass"))
        moved = checkpointed(moved)
        parts.append(at(moved, F.when(F.col("action").isNotNull(), "target").when(F.col("ends"), "terminal").otherwise("alive")))
        here = moved.filter("action is null and not ends").select("start", F.col("dst").alias("node"), "mass")
    return reduce(DataFrame.unionByName, parts).select(F.col("start").alias("src"), "kind", "action", "change", "score")


def macro_first_passage(jumps: DataFrame, macros: DataFrame, targets: list[str], k: int, terminals: DataFrame | None = None) -> DataFrame:
    """(src, action, change, score, kind) and residual masses over k macro changes: a target is taken on arrival.

    Masses: no_model, retained, unresolved, terminal (see `passage_by_step`), step_limit for what
    is still on its way; with the scores they add up to 1.
    """
    rows = passage_by_step(jumps, macros, targets, k, terminals).filter(F.expr(f"kind <> 'alive' or change = {k}"))
    kind = F.when(F.col("kind") == "alive", "step_limit").otherwise(F.col("kind"))
    change = F.when(F.col("kind") == "target", F.col("change"))
    return rows.groupBy("src", "action", change.alias("change"), kind.alias("kind")).agg(F.sum("score").alias("score")).select("src", "action", "change", "score", "kind")


def memory_graph(dests: DataFrame, states: DataFrame, start_memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and macros of the graph whose nodes are (state, memory) pairs, as `state|memory`.

    dests: state, context, dest, p; states: the catalog; start_memories: memory. Entering a
    business funnel sets the memory; technical steps and service channels keep it. A technical
    origin uses the model of its memory if there is one, else the origin's.
    """
    memories = start_memories.select("memory").union(states.filter("funnel is not null and not technical").select("funnel")).distinct()
    known = states.select("state", "funnel", "macro", "technical")
    nodes = known.crossJoin(F.broadcast(memories)).filter(F.col("technical") | F.col("funnel").isNull() | (F.col("memory") == F.col("funnel")))  # states and funnels: catalog sizes
    models = dests.select("state", "context").distinct()
    own = nodes.join(models, (nodes.state == models.state) & (models.context == nodes.memory) & nodes.technical, "left").select(nodes["*"], models.context.alias("_own"))
    routed = own.withColumn("context", F.coalesce("_own", F.lit(BASE)))
    after = known.select(F.col("state").alias("dest"), F.col("funnel").alias("dest_funnel"), F.col("technical").alias("dest_technical"))
    edges = routed.join(dests, ["state", "context"]).join(after, "dest", "left")
    memory = F.when(F.col("dest_funnel").isNotNull() & ~F.col("dest_technical"), F.col("dest_funnel")).otherwise(F.col("memory"))
    name = lambda s, m: F.concat_ws("|", s, m)
    macros = nodes.select(name("state", "memory").alias("node"), "macro", "state", "memory")
    return edges.select(name("state", "memory").alias("src"), name("dest", memory).alias("dst"), "p"), macros


def step_coefficients(passage: DataFrame, dests: DataFrame, macros: DataFrame, targets: list[str], keys: list[str], node_of: Column, k: int, own_macro: Column, terminals: DataFrame | None = None) -> DataFrame:
    """(keys, grp, kind, action, change, coefficient): what a unit of weight on a duration group gives each action at each of k
    macro changes, and each residual mass; a group's coefficients add up to 1 if its r do.

    passage: see `passage_by_step`; dests: keys, dest, grp, r. `node_of` names the node of a
    destination, `own_macro` is the macro that the case is in. A destination in another macro is
    the first change itself, so k - 1 of its node's changes follow; one in the same macro is no
    change. What is left after the last change is `step_limit`.
    """
    named = dests.select(*keys, "grp", "r", node_of.alias("_node"), own_macro.alias("_own")).join(macros.select(F.col("node").alias("_node"), F.col("macro").alias("_macro")), "_node", "left")
    ends = F.lit(False)
    if terminals is not None:
        named, ends = named.join(terminals.select(F.col("node").alias("_node"), F.lit(True).alias("_ends")), "_node", "left"), F.coalesce("_ends", F.lit(False))
    named = checkpointed(named.withColumn("_used", F.when(F.col("_macro") == F.col("_own"), 0).otherwise(1)).withColumn("_ends", ends))
    head, away = [*keys, "grp"], F.col("_used") == 1
    no_action = F.lit(None).cast("string").alias("action")
    hit = away & F.col("_macro").isin(targets)
    direct = named.filter(hit).select(*head, F.lit("target").alias("kind"), F.col("_macro").alias("action"), F.lit(1).alias("change"), F.col("r").alias("c"))
    rest = named.filter(~F.coalesce(hit, F.lit(False)))
    stop = rest.filter("_ends").select(*head, F.lit("terminal").alias("kind"), no_action, F.col("_used").alias("change"), F.col("r").alias("c"))
    rest = rest.filter("not _ends")
    if k == 1:  # a first change elsewhere leaves nothing to go
        limit = rest.filter(away).select(*head, F.lit("step_limit").alias("kind"), no_action, F.lit(1).alias("change"), F.col("r").alias("c"))
        rest = rest.filter(~away)
    # destinations without any way on: nothing is known of what comes next
    lone = rest.join(passage.select(F.col("src").alias("_node")).distinct(), "_node", "left_anti").select(*head, F.lit("no_model").alias("kind"), no_action, (F.col("_used") + 1).alias("change"), F.col("r").alias("c"))
    on = rest.join(passage, rest["_node"] == passage["src"]).withColumn("_left", F.lit(k) - F.col("_used"))
    on = on.filter((F.col("change") <= F.col("_left")) & ((F.col("kind") != "alive") | (F.col("change") == F.col("_left"))))
    onward = on.select(*head, F.when(F.col("kind") == "alive", "step_limit").otherwise(F.col("kind")).alias("kind"), "action", (F.col("change") + F.col("_used")).alias("change"), (F.col("r") * F.col("score")).alias("c"))
    rows = reduce(DataFrame.unionByName, [direct, stop, lone, onward, *([limit] if k == 1 else [])])
    return rows.groupBy(*head, "kind", "action", "change").agg(F.sum("c").alias("coefficient"))


def step_scores(weights: DataFrame, coefficients: DataFrame, keys: list[str], case: list[str]) -> DataFrame:
    """(case, kind, action, change, score) of each case from its group weights; one join and one aggregation."""
    rows = weights.join(coefficients, [*keys, "grp"]).groupBy(*case, "kind", "action", "change")
    return rows.agg(F.sum(F.col("weight") * F.col("coefficient")).alias("score"))


def score_arrays(scores: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Of each key and action the scores by change as an array, their sum and the likeliest change; the residual masses stand beside, the same for all actions of a key."""
    steps = F.array(*(F.coalesce(F.sum(F.when(F.col("change") == h, F.col("score"))), F.lit(0.0)) for h in range(1, k + 1)))
    masses = scores.filter("kind <> 'target'").groupBy(*keys).agg(*(F.coalesce(F.sum(F.when(F.col("kind") == name, F.col("score"))), F.lit(0.0)).alias(name) for name in MASSES))
    actions = scores.filter("kind = 'target'").groupBy(*keys, "action").agg(steps.alias("by_change"), F.sum("score").alias("score"))
    best = F.array_position("by_change", F.array_max("by_change")).cast("int")
    return actions.withColumn("best_change", best).join(masses, keys, "full").fillna(0.0, list(MASSES))


MASSES = ("no_model", "terminal", "retained", "unresolved", "step_limit")


def routed_scores(cases: DataFrame, supported: DataFrame, parent: tuple[DataFrame, DataFrame], child: tuple[DataFrame, DataFrame], case: list[str]) -> DataFrame:
    """(case, route, model_context, dest, p, q): every case scored by the model that its route names.

    cases: case columns, state, context, age; parent: dests and groups keyed by state; child:
    those of contexts, keyed by state and context (see `models.recombined`). A case takes its
    context's groups where they are fitted, else its origin's; one whose origin has no model
    keeps one row with a null destination.
    """
    (dests, groups), (child_dests, child_groups) = parent, child
    routes = routed(cases.select(*case, "state", "context", "age"), supported, groups.select("state").distinct(), child_groups.select("state", "context").distinct())
    stacked = lambda own, of_context: own.withColumn("model_context", F.lit(BASE)).unionByName(of_context.withColumnRenamed("context", "model_context"))
    dests = stacked(dests.select("state", "dest", "grp", "r", "p"), child_dests.select("state", "context", "dest", "grp", "r", "p"))
    groups = stacked(groups.select("state", "grp", "family", "p1", "p2", "pi"), child_groups.select("state", "context", "grp", "family", "p1", "p2", "pi"))
    scored = conditioned(routes.filter("model_context is not null").select(*case, "state", "model_context", "age"), groups, dests, ["state", "model_context"], case)
    return routes.select(*case, "route", "model_context").join(scored.select(*case, "dest", "p", "q"), case, "left")


def distinct_conditions(cases: DataFrame, condition: list[str]) -> DataFrame:
    """Each condition once, to be scored and joined back."""
    return cases.select(*condition).distinct()


def to_lists(scores: DataFrame, case: list[str], k: int = 5, action: str = "action") -> DataFrame:
    """DM13, L18: one row a case with the array of its k best (rank, action, score) and the map of all; scores of 0 never fill the list."""
    positive = scores.filter("score > 0")
    best = top_k(positive, case, [F.desc("score"), F.asc(action)], k).groupBy(*case).agg(F.sort_array(F.collect_list(F.struct("rank", F.col(action).alias("action"), "score"))).alias("top"))
    every = scores.groupBy(*case).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(action), "score")))).alias("scores"))
    return every.join(best, case, "left")


def to_long(wide: DataFrame, case: list[str], context: dict[str, Column]) -> DataFrame:
    """A row for each entry of `top`, with a JSON context; a case without entries keeps one placeholder row."""
    entries = F.filter(F.coalesce("top", F.array().cast("array<struct<rank:int,action:string,score:double>>")), lambda e: e.score.isNotNull())
    rows = wide.withColumn("_context", F.to_json(F.struct(*(c.alias(n) for n, c in context.items())))).select(*case, "_context", F.explode_outer(entries).alias("e"))
    return rows.select(*case, F.col("e.rank").alias("rank"), F.col("e.action").alias("action"), F.col("e.score").alias("score"), F.col("_context").alias("context_json"), F.when(F.col("e").isNull(), "sem_previsao").otherwise("ok").alias("row_status"))


def aligned(rows: DataFrame, case: list[str], raw: str, useful: str, k: int = 5) -> DataFrame:
    """Two rankings of a case side by side, row i with the i-th entry of each."""
    at = lambda c, f: F.try_element_at(F.col(c), F.col("rank"))[f]
    return rows.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(k)))).select(
        *case, "rank", at(raw, "action").alias("raw_action"), at(raw, "score").alias("raw_score"), at(useful, "action").alias("useful_action"), at(useful, "score").alias("useful_score")
    ).filter("raw_action is not null or useful_action is not null")


def immediate_macros(q: DataFrame, states: DataFrame, case: list[str], k: int = 5) -> DataFrame:
    """Next-state probabilities summed by macro action, the k largest."""
    summed = q.join(states.select(F.col("state").alias("dest"), "macro"), "dest").groupBy(*case, "macro").agg(F.sum("q").alias("score"))
    return top_k(summed, case, [F.desc("score"), F.asc("macro")], k)

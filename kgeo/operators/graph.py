"""The relation graph: neighbours, edges, paths, walks.

``sequence``: relation_id, composition_id, ordinal, occurrences. ``rating``: relation_id, rating, observations.
``edges``: src, dst, elo, obs, n; symmetric."""

import heapq
import math
import random
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgeo.functions import scoring, text


def links(sequence: DataFrame, rating: DataFrame) -> DataFrame:
    """A row per relation and ordered pair of different compositions in it, with the relation's rating."""
    a, b = sequence.select("relation_id", F.col("composition_id").alias("src")), sequence.select("relation_id", F.col("composition_id").alias("dst"))
    return a.join(b, "relation_id").filter("src <> dst").join(rating, "relation_id").select("src", "dst", "relation_id", "rating", "observations")


def edges(sequence: DataFrame, rating: DataFrame) -> DataFrame:
    """Parallel links merged: highest rating, observations added up."""
    return links(sequence, rating).groupBy("src", "dst").agg(F.max("rating").alias("elo"), F.sum("observations").alias("obs"), F.count("*").alias("n"))


def neighbours(sequence: DataFrame, start: DataFrame) -> DataFrame:
    """Links of the compositions in ``start`` (column src) alone: the start is joined first, so the self-join stays small."""
    mine = sequence.join(start.withColumnRenamed("src", "composition_id"), "composition_id").select("relation_id", F.col("composition_id").alias("src"))
    return mine.join(sequence.select("relation_id", F.col("composition_id").alias("dst"), "ordinal"), "relation_id").filter("src <> dst")


def multi_hop(edges_: DataFrame, start: DataFrame, max_hops: int = 3, min_elo: float = 1000, limit: int | None = 100) -> DataFrame:
    """Simple paths of up to ``max_hops`` edges of at least ``min_elo``: start, node, depth, path, total_elo, avg_elo.

    One join per hop; a node is not entered twice."""
    good = edges_.filter(F.col("elo") >= min_elo).select("src", "dst", "elo")
    now = start.select(F.col("src").alias("start"), F.col("src").alias("node"), F.array("src").alias("path"), F.lit(0.0).alias("total_elo"))
    all_ = None
    for depth in range(1, max_hops + 1):
        now = now.join(good, now["node"] == good["src"]).filter(~F.array_contains("path", F.col("dst"))).select("start", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"), (F.col("total_elo") + F.col("elo")).alias("total_elo"))
        step = now.withColumn("depth", F.lit(depth))
        all_ = step if all_ is None else all_.unionByName(step)
    out = all_.withColumn("avg_elo", F.col("total_elo") / F.col("depth")).select("start", "node", "depth", "path", "total_elo", "avg_elo")
    return out if limit is None else out.orderBy(F.desc("avg_elo"), "depth", "path").limit(limit)


def cheapest(edges_: DataFrame, start: DataFrame, max_hops: int = 10, min_elo: float = 1200) -> DataFrame:
    """Least cost (2000 - elo) / 1000 from ``start`` to every node within ``max_hops`` edges of at least ``min_elo``: one
    relaxation per hop, the best cost per node kept, so the frontier is no larger than the graph."""
    cost = edges_.filter(F.col("elo") >= min_elo).select("src", "dst", ((2000 - F.col("elo")) / 1000).alias("c"))
    best = start.select(F.col("src").alias("node"), F.lit(0.0).alias("cost"), F.lit(0).alias("hops"))
    for hop in range(1, max_hops + 1):
        step = best.join(cost, best["node"] == cost["src"]).select(F.col("dst").alias("node"), (F.col("cost") + F.col("c")).alias("cost"), F.lit(hop).alias("hops"))
        best = best.unionByName(step).groupBy("node").agg(F.min(F.struct("cost", "hops")).alias("b")).select("node", "b.cost", "b.hops")
    return best


class Adjacency:
    """Neighbour lists for point queries, fetched for a frontier at a time: only what a search visits comes to the driver."""

    def __init__(self, edges_: DataFrame, min_elo: float = 800, min_obs: int = 1):
        self.edges, self.known = edges_.filter((F.col("elo") >= min_elo) & (F.col("obs") >= min_obs)), {}

    def fetch(self, nodes: Iterable) -> None:
        new = [n for n in dict.fromkeys(nodes) if n not in self.known]
        if new:
            for n in new:
                self.known[n] = []
            for r in self.edges.filter(F.col("src").isin(new)).select("src", "dst", "elo", "obs", scoring.edge_cost(F.col("elo"), F.col("obs")).alias("cost")).collect():
                self.known[r.src].append((r.dst, r.cost, r.elo, r.obs))

    def of(self, node) -> list[tuple]:
        self.fetch([node])
        return sorted(self.known[node])


def a_star(adjacency: Adjacency, start, goals: set, heuristic: Callable[[object], float] | None = None, weight: float = 1.0, max_expansions: int = 10_000) -> dict | None:
    """Best path from ``start`` to the first goal reached: path, cost, avg_elo, avg_obs, expanded. None if there is none.

    Edge costs are at least 1 while a geodesic may reach pi, so with ``weight`` 1 the path may not be the cheapest; with 0
    (plain Dijkstra) or at most 1 / pi it is."""
    h = (lambda n: weight * heuristic(n)) if heuristic and weight else (lambda n: 0.0)
    queue, cost, came, done = [(h(start), 0, start)], {start: 0.0}, {}, set()
    serial = 0
    while queue and len(done) < max_expansions:
        _, _, node = heapq.heappop(queue)
        if node in done:
            continue
        if node in goals:
            path, elos, seen = [node], [], []
            while path[-1] in came:
                before, elo, obs = came[path[-1]]
                path.append(before)
                elos.append(elo)
                seen.append(obs)
            n = max(1, len(elos))
            return {"path": path[::-1], "cost": cost[node], "avg_elo": sum(elos) / n, "avg_obs": sum(seen) / n, "expanded": len(done)}
        done.add(node)
        if not len(done) % 16 or node not in adjacency.known:
            adjacency.fetch([node, *(x[2] for x in heapq.nsmallest(32, queue))])
        for dst, c, elo, obs in adjacency.of(node):
            if cost[node] + c < cost.get(dst, math.inf) - 1e-15:
                cost[dst], came[dst] = cost[node] + c, (node, elo, obs)
                serial += 1
                heapq.heappush(queue, (cost[dst] + h(dst), serial, dst))
    return None


def candidates(edges_: DataFrame, names: DataFrame, min_obs: float = 1.0) -> DataFrame:
    """Per source the neighbours a walk may go to, with their local scores: elo_score, obs_score, strength, is_stop.

    ``names``: id, text. Ratings are scaled to the source's own range and observations to its largest count."""
    w = Window.partitionBy("src")
    scaled = edges_.withColumns({"_top": F.greatest(F.lit(1.0), F.max("obs").over(w).cast("double")), "_low": F.min("elo").over(w), "_span": F.greatest(F.lit(1.0), F.max("elo").over(w) - F.min("elo").over(w))})
    named = scaled.join(names.select(F.col("id").alias("dst"), "text"), "dst").filter(~text.is_artifact(F.col("text")) & (F.col("obs") >= min_obs))
    return named.select("src", "dst", "text", ((F.col("elo") - F.col("_low")) / F.col("_span")).alias("elo_score"), (F.col("obs") / F.col("_top")).alias("obs_score"), F.col("obs").alias("strength"), text.is_function_word(F.col("text")).alias("is_stop"))


#: Weights of a walk's score.
WALK = {"model": 0.35, "text": 0.40, "rel": 0.15, "repeat": 0.25, "novelty": 0.15, "energy": 0.10, "decay": 0.03, "seed": 0.3, "recent": 16, "top": 32}


def base_score(energy: float = 1.0, weights: dict | None = None):
    """A candidate's score before any visits: a column over ``candidates``."""
    p = WALK | (weights or {})
    raw = p["model"] * F.col("elo_score") + p["text"] * F.col("obs_score") + p["rel"] * scoring.sigmoid(F.col("strength") / 50.0)
    return F.pow(F.greatest(F.lit(0.0), F.when(F.col("is_stop"), F.least(raw, F.lit(0.02))).otherwise(raw + 0.05) + p["energy"] * energy), F.lit(0.75))


def walk(candidates_: DataFrame, start, steps: int = 20, goal=None, seeds: frozenset = frozenset(), energy: float = 1.0, seed: int = 0, weights: dict | None = None) -> list[dict]:
    """A stochastic walk from ``start``: a row per step with node, text, probability and energy; the last one says why it ended.

    Each step samples among the ``top`` scores with a temperature that falls with energy. Only the current node's neighbours
    are fetched. The whole state is kept, so visits and the recent window count from the first step."""
    p, rng = WALK | (weights or {}), random.Random(seed)
    visits, recent, now, out, seen = {start: 1}, [start], start, [], {}
    for _ in range(steps):
        if now not in seen:
            seen[now] = candidates_.filter(F.col("src") == now).drop("src").collect()
        scored = []
        for c in sorted(seen[now], key=lambda c: c.dst):
            s = p["model"] * c.elo_score + p["text"] * c.obs_score + p["rel"] / (1 + math.exp(-c.strength / 50.0))
            s = min(s, 0.02) if c.is_stop else s + 0.05
            s += p["seed"] * (c.dst in seeds) - p["repeat"] * visits.get(c.dst, 0) - p["novelty"] * (c.dst in recent) + p["energy"] * energy
            scored.append((max(0.0, s) ** 0.75, c))
        scored.sort(key=lambda x: (-x[0], x[1].dst))
        scored = scored[: p["top"]]
        if not scored or scored[0][0] <= 0:
            return [*out, {"node": now, "text": None, "probability": None, "energy": energy, "end": "trapped"}]
        heat = min(0.55, max(0.35, 0.55 - 0.2 * energy))
        shares = [math.exp((s - scored[0][0]) / heat) for s, _ in scored]
        at = rng.choices(range(len(scored)), shares)[0]
        chosen, energy = scored[at][1], energy - p["decay"]
        now = chosen.dst
        visits[now] = visits.get(now, 0) + 1
        recent = [*recent, now][-p["recent"] :]
        end = "goal" if now == goal else "energy" if energy <= 0 else None
        out.append({"node": now, "text": chosen.text, "probability": shares[at] / sum(shares), "energy": energy, "end": end})
        if end:
            break
    return out


def relation_tree(sequence: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """Relations reached from ``roots`` (relation_id) through shared first compositions, each once per path: root, relation_id, depth, path."""
    first = sequence.filter("ordinal = 0").select("relation_id", "composition_id")
    child = sequence.filter("ordinal > 0").select(F.col("relation_id").alias("parent"), "composition_id").join(first.withColumnRenamed("relation_id", "child"), "composition_id").select("parent", "child").distinct()
    now = roots.select(F.col("relation_id").alias("root"), "relation_id", F.lit(0).alias("depth"), F.array("relation_id").alias("path"))
    all_ = now
    for d in range(1, depth + 1):
        now = now.join(child, now["relation_id"] == child["parent"]).filter(~F.array_contains("path", F.col("child"))).select("root", F.col("child").alias("relation_id"), F.lit(d).alias("depth"), F.array_append("path", F.col("child")).alias("path"))
        all_ = all_.unionByName(now)
    return all_

"""Known facts, gaps, plans, intentions, feedback: what is asked of and learned from the graph."""

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgeo.functions import scoring, text


def known_facts(links: DataFrame, names: DataFrame, topic: str, limit: int = 20) -> DataFrame:
    """Links of the topic with elo over 1400 and over 5 observations, by mass: id, text, mass."""
    start = names.filter(F.lower("text") == topic.lower()).select(F.min("id").alias("src"))
    good = links.join(start, "src").filter("rating > 1400 AND observations > 5").groupBy(F.col("dst").alias("id")).agg(F.max(scoring.mass(F.col("rating"), F.col("observations"))).alias("mass"))
    return good.join(names, "id").select("id", "text", "mass").orderBy(F.desc("mass"), "id").limit(limit)


def standing(sequence: DataFrame, rating: DataFrame) -> DataFrame:
    """Per composition the best rating of its relations and all their observations: id, elo, obs."""
    return sequence.select("composition_id", "relation_id").distinct().join(rating, "relation_id").groupBy(F.col("composition_id").alias("id")).agg(F.max("rating").alias("elo"), F.sum("observations").alias("obs"))


def knowledge_gaps(standing_: DataFrame, names: DataFrame, limit: int = 10, low: float = 1200, few: int = 5) -> DataFrame:
    """Compositions whose elo is under ``low`` or that were observed under ``few`` times (or never), least known first: id, text, elo, obs, confidence."""
    out = names.join(standing_, "id", "left").select("id", "text", F.coalesce("elo", F.lit(0.0)).alias("elo"), F.coalesce("obs", F.lit(0)).alias("obs")).filter((F.col("elo") < low) | (F.col("obs") < few))
    return out.withColumn("confidence", F.col("elo") / 2000).orderBy("elo", "obs", "id").limit(limit)


def solvable(problems: DataFrame, names: DataFrame, links: DataFrame) -> DataFrame:
    """Per problem (id, text): keywords, how many have a link with elo over 1500 and over 10 observations, and whether these are
    one at least and 30 of 100."""
    words = problems.select("id", F.explode(F.array_distinct(text.keywords(F.col("text"), text.PROBLEM_STOPS))).alias("keyword"))
    strong = links.filter("rating > 1500 AND observations > 10").select(F.col("src").alias("cid")).distinct()
    good = names.join(strong, names["id"] == strong["cid"], "left_semi").select(F.lower("text").alias("keyword")).distinct().withColumn("known", F.lit(1))
    counted = words.join(good, "keyword", "left").groupBy("id").agg(F.count("*").alias("keywords"), F.count("known").alias("known"))
    return problems.select("id").join(counted, "id", "left").select("id", F.coalesce("keywords", F.lit(0)).alias("keywords"), F.coalesce("known", F.lit(0)).alias("known")).withColumn("solvable", (F.col("known") >= 1) & (F.col("known") >= 0.3 * F.col("keywords")))


def decompose(links: DataFrame, start: DataFrame, max_depth: int = 5, strong: float = 1800) -> DataFrame:
    """Subproblems reached from ``start`` (id): node, depth, solvable (a link into it has elo over ``strong``), difficulty.

    Solvable ones are not opened; a node is taken at its least depth only, so cycles end."""
    best = links.groupBy("src", "dst").agg(F.max("rating").alias("elo"))
    seen = start.select(F.col("id").alias("node"), F.lit(0).alias("depth"), F.lit(0.0).alias("elo"))
    now = seen
    for depth in range(1, max_depth + 1):
        step = now.filter(F.col("elo") <= strong).join(best.withColumnRenamed("elo", "e"), F.col("node") == F.col("src")).groupBy("dst").agg(F.max("e").alias("elo"))
        now = step.select(F.col("dst").alias("node"), F.lit(depth).alias("depth"), "elo").join(seen.select("node"), "node", "left_anti")
        seen = seen.unionByName(now)
    return seen.select("node", "depth", (F.col("elo") > strong).alias("solvable"), (10 * (1 - F.col("elo") / 2000)).cast("int").alias("difficulty"))


def research_plan(gaps: DataFrame, sequence: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each gap with its urgency by confidence and the number of different contents that bear on its relations."""
    sources = sequence.select(F.col("composition_id").alias("id"), "relation_id").distinct().join(evidence, "relation_id").groupBy("id").agg(F.count_distinct("content_id").alias("sources"))
    level = F.when(F.col("confidence") < 0.1, "CRITICAL").when(F.col("confidence") < 0.5, "WEAK").otherwise("MODERATE")
    return gaps.join(sources, "id", "left").select("id", "text", "confidence", level.alias("level"), F.coalesce("sources", F.lit(0)).alias("sources"))


def orient(evidence: DataFrame, before, min_rows: int = 5) -> DataFrame:
    """Per relation with over ``min_rows`` rows of evidence up to ``before``: n, signed mean signal, rating change."""
    signed = F.avg(F.when(F.col("is_valid"), F.col("signal")).otherwise(-F.col("signal")))
    out = evidence.filter(F.col("validated_at") < before).groupBy("relation_id").agg(F.count("*").alias("n"), signed.alias("mean_signal")).filter(F.col("n") > min_rows)
    return out.withColumn("delta", scoring.feedback_delta(F.col("mean_signal"), F.col("n")))


def act(rating: DataFrame, changes: DataFrame) -> DataFrame:
    """Ratings with the changes added, each changed one observed once more."""
    return rating.join(changes.select("relation_id", "delta"), "relation_id", "left").select("relation_id", (F.col("rating") + F.coalesce("delta", F.lit(0))).alias("rating"), (F.col("observations") + F.col("delta").isNotNull().cast("int")).alias("observations"))


def fold_votes(votes: DataFrame) -> DataFrame:
    """``votes``: src, dst, kind, weight, model, seq. Per edge the integer running mean of votes in order of seq, the number of
    votes and the models in order (JSON)."""
    ordered = F.sort_array(F.collect_list(F.struct("seq", scoring.vote_rating(F.col("weight")).alias("vote"), "model")))
    edge = votes.groupBy("src", "dst", "kind").agg(ordered.alias("votes"))
    start = F.struct(F.lit(0).alias("elo"), F.lit(0).alias("n"))
    folded = F.aggregate("votes", start, lambda s, v: F.struct(scoring.folded_vote(s["elo"], s["n"], v["vote"]).alias("elo"), (s["n"] + 1).alias("n")))
    return edge.select("src", "dst", "kind", folded.alias("f"), F.to_json(F.transform("votes", lambda v: v["model"])).alias("provenance")).select("src", "dst", "kind", "f.elo", "f.n", "provenance")


def observe(turns: DataFrame, names: DataFrame, last: int = 3) -> DataFrame:
    """Per conversation the distinct keywords of its last turns, in order, and the compositions they name: conv_id, keywords, ids."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text")
    words = turns.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= last).select("conv_id", F.explode(text.keywords(F.coalesce("text", F.lit("")))).alias("keyword")).distinct()
    named = names.groupBy(F.lower("text").alias("keyword")).agg(F.min("id").alias("id"))
    return words.join(named, "keyword", "left").groupBy("conv_id").agg(F.sort_array(F.collect_list("keyword")).alias("keywords"), F.sort_array(F.collect_list("id")).alias("ids"))


def intentions(subproblems: DataFrame, bridges: DataFrame, facts: DataFrame, keep: int = 8) -> DataFrame:
    """Goals (node) by priority: subproblems 1 - difficulty / 10, bridges 0.8, facts 0.5; the best of each node, ``keep`` of them."""
    all_ = subproblems.select("node", (1 - F.col("difficulty") / 10).alias("priority"), F.lit("subproblem").alias("kind")).unionByName(bridges.select("node", F.lit(0.8).alias("priority"), F.lit("bridge").alias("kind"))).unionByName(facts.select("node", F.lit(0.5).alias("priority"), F.lit("fact").alias("kind")))
    one = all_.groupBy("node").agg(F.max(F.struct("priority", "kind")).alias("b")).select("node", "b.priority", "b.kind")
    return one.orderBy(F.desc("priority"), "node").limit(keep)


def hypothesis_score(resolved: float, elo: float, coverage: float) -> float:
    return 0.5 * resolved + 0.3 * elo / 2000 + 0.2 * coverage


def reason(adjacency, start, goals: list, rounds: int = 3, beam: int = 4, max_expansions: int = 2000) -> dict:
    """Chains of best paths through the goals, tried in rotated orders; a round without any lowers the least elo by 200 (600 at
    least) and doubles the expansions. Returns the best hypothesis: path, resolved, elo, score, round."""
    from kgeo.operators.graph import Adjacency, a_star

    best = {"path": [start], "resolved": 0.0, "elo": 0.0, "score": 0.0, "round": 0}
    for k in range(rounds):
        near = adjacency if k == 0 else Adjacency(adjacency.edges.filter(F.col("elo") >= max(600, 800 - 200 * k)))
        for turn in range(min(beam, max(1, len(goals)))):
            path, elos, got = [start], [], 0
            for goal in goals[turn:] + goals[:turn]:
                found = a_star(near, path[-1], {goal}, max_expansions=max_expansions * 2**k)
                if found:
                    path, got = path + found["path"][1:], got + 1
                    elos.append(found["avg_elo"])
            elo = sum(elos) / len(elos) if elos else 0.0
            score = hypothesis_score(got / max(1, len(goals)), elo, len(set(path)) / max(1, len(path)))
            if got and score > best["score"]:
                best = {"path": path, "resolved": got / len(goals), "elo": elo, "score": score, "round": k}
        if best["resolved"] == 1:
            break
    return best


def stream_tokens(answer: str) -> Iterator[str]:
    """An answer piece by piece, as a token callback gets it."""
    yield from answer.split()

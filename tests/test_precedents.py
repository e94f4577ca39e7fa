"""Similar projects against a plain ranking of all pairs, and how few rows of a group are looked at."""

import random

from pyspark.sql import functions as F

from recordqc.operators import precedents as P

FACTS = "project_id long, project_name string, square_feet double, building_type string, canonical string, excluded boolean, review_required boolean, has_mech boolean, has_elec boolean"
ASKED = "request_id long, square_feet double, building_type string, consultant string, scope string"


def _facts(n):
    rng = random.Random(n)
    return [(i, f"P{rng.randint(0, 20)}", rng.choice([None, 0.0, 500.0, 1000.0, 2000.0, float(rng.randint(1, 4000))]), rng.choice(["Office ", "office", "School", None, "Lab"]),
             rng.choice(["Acme", "Delta", "Unknown", "Other"]), rng.random() < .1, rng.random() < .1, rng.random() < .6, rng.random() < .6) for i in range(n)]


REQUESTS = [(1, 1000.0, "office", "acme", "Mechanical"), (2, 1000.0, "School", "", "Mechanical + Electrical"), (3, 40.0, "none", "nobody", "Electrical"), (4, 9000.0, "Lab", "Delta", "Mechanical + Electrical")]


def _plain(facts, request, k=5):
    _, want, t, c, scope = request
    found = []
    for i, name, sf, kind, who, out, review, mech, elec in facts:
        if out or review or not {"Mechanical": mech, "Electrical": elec}.get(scope, mech or elec):
            continue
        delta = abs((sf or 0.0) - want)
        score = 50 * ((kind or "").strip().lower() == t.lower()) + 30 * (c != "" and who.lower() == c.lower()) + (max(0.0, (1 - min(delta / want, 1)) * 30) if sf else 0)
        score += 5 * (scope == "Mechanical + Electrical" and mech and elec)
        found.append((-int(score * 10 + .5) / 10, delta, name, i))
    return [(x[3], -x[0]) for x in sorted(found)[:k]]


def test_rank_similar_equals_a_plain_ranking(spark):
    for n in (3, 400):
        rows = P.rank_similar(spark.createDataFrame(REQUESTS, ASKED), spark.createDataFrame(_facts(n), FACTS)).collect()
        for r in REQUESTS:
            assert [(x.project_id, x.score) for x in sorted(rows, key=lambda x: x["rank"]) if x.request_id == r[0]] == _plain(_facts(n), r)


def test_the_requests_decide_how_many_projects_are_placed(spark):
    """300 types and consultants that nobody asks for, all areas different: four requests leave so many rows at most, whatever the projects."""
    facts = spark.range(6000).select(F.col("id").alias("project_id"), F.lit("P").alias("project_name"), F.col("id").cast("double").alias("square_feet"), F.concat(F.lit("t"), (F.col("id") % 300).cast("string")).alias("building_type"),
                                     F.concat(F.lit("c"), (F.col("id") % 300).cast("string")).alias("canonical"), F.lit(False).alias("excluded"), F.lit(False).alias("review_required"), F.lit(True).alias("has_mech"), F.lit(True).alias("has_elec"))
    asked = spark.createDataFrame([(sf, t, c) for _, sf, t, c, _ in REQUESTS], "sf double, t string, c string")
    assert P._nearest(facts, asked, 5).count() <= 3 * 4 * 10

"""Issues of an import against the stored ones and against earlier ones of the same batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordqc.operators.issues import _note_tokens
from recordqc.operators.scale import first_per
from recordqc.session import written

C = F.col
SHARE = 0.65
NODE = ("project_id", "project_number", "discipline", "tokens", "alone")


def attach_projects(incoming: DataFrame, projects: DataFrame) -> DataFrame:
    """Incoming issues with the id and number of the first stored project that has their number, or else their name."""
    p = projects.select("seq", C("project_id").alias("p_id"), C("project_number").alias("p_number"), "project_name")
    by = lambda key, col, name: first_per(p.where(C(col).isNotNull() & (C(col) != "")), [col], ["seq"]).select(C(col).alias(key), F.struct("p_id", "p_number").alias(name))
    j = incoming.join(by("project_number", "p_number", "numbered"), "project_number", "left").join(by("project_name", "project_name", "named"), "project_name", "left")
    hit = F.coalesce("numbered", "named")
    return j.withColumns({"project_id": F.when(hit.isNotNull(), hit["p_id"]).otherwise(C("project_id")), "project_number": F.when(hit.isNotNull(), hit["p_number"]).otherwise(C("project_number"))}) \
        .drop("numbered", "named")


def _nodes(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Issues that are alike by definition are one node, named by its first row: stored rows (side 0) come before imported ones (side 1)."""
    field = lambda c: F.coalesce(C(c).cast("string"), F.lit("")).alias(c)
    rows = lambda df, side: df.select(field("project_id"), F.lower(field("project_number")).alias("project_number"), field("discipline"), field("category"), F.lower(field("message")).alias("message"),
                                      F.struct(F.lit(side).alias("side"), "seq").alias("at"))
    r = rows(existing, 0).unionByName(rows(incoming, 1)).withColumn("tokens", F.array_sort(_note_tokens(C("message"))))
    # without tokens only equal category and text make issues alike
    alone = F.when(F.size("tokens") == 0, F.struct("category", "message"))
    return r.withColumn("alone", alone).groupBy("project_id", "project_number", "discipline", "tokens", "alone").agg(F.min("at").alias("node"))


def issue_links(nodes: DataFrame, share: float = SHARE) -> DataFrame:
    """(node, earlier): pairs of nodes of one project, by id or by number, and one discipline whose texts are alike.

    Texts are alike if they share ``share`` of the larger one's tokens, or if category and text are equal. They meet over the rarest tokens of each, as many as the threshold leaves room to miss, plus one;
    there the sizes and the places of the token bound what they can share before any sets are compared. A hot (project, token) key is an ordinary sort-merge join that adaptive execution splits.
    """
    keys = F.filter(F.array(F.when(C("project_id") != "", F.concat(F.lit("i"), "project_id")), F.when(C("project_number") != "", F.concat(F.lit("n"), "project_number"))), lambda x: x.isNotNull())
    common = nodes.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("f"))
    order = nodes.where(F.size("tokens") > 0).select("node", F.explode("tokens").alias("t")).join(common, "t").groupBy("node") \
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "t"))), lambda x: x["t"]).alias("rare"))
    n = nodes.withColumn("k", F.explode(keys)).join(order, "node", "left")
    size = F.size("rare")
    probe = n.where(size > 0).select("k", "discipline", "node", "rare", F.posexplode(F.slice("rare", F.lit(1), size - F.ceil(size * share).cast("int") + 1)).alias("i", "t"))
    other = probe.select("k", "discipline", "t", C("node").alias("earlier"), C("rare").alias("theirs"), C("i").alias("j"))
    mine, their = F.size("rare"), F.size("theirs")
    need = F.ceil(F.greatest(mine, their) * share)
    fits = (F.least(mine, their) >= need) & (F.least("i", "j") + F.least(mine - C("i"), their - C("j")) >= need)
    met = probe.join(other, ["k", "discipline", "t"]).where((C("earlier") < C("node")) & fits)
    pairs = met.where(F.size(F.array_intersect("rare", "theirs")) / F.greatest(mine, their) >= share).select("node", "earlier")
    bare = n.where(C("alone").isNotNull()).select("k", "discipline", "alone", "node")
    same = bare.join(bare.withColumnRenamed("node", "earlier"), ["k", "discipline", "alone"]).where("earlier < node").select("node", "earlier")
    return pairs.unionByName(same).distinct()


def _with_nodes(incoming: DataFrame, nodes: DataFrame) -> DataFrame:
    """``seq`` of each incoming issue with the columns of its node."""
    field = lambda c: F.coalesce(C(c).cast("string"), F.lit(""))
    tokens = F.array_sort(_note_tokens(F.lower(field("message"))))
    rows = incoming.select("seq", field("project_id").alias("project_id"), F.lower(field("project_number")).alias("project_number"), field("discipline").alias("discipline"), field("category").alias("category"),
                           F.lower(field("message")).alias("message")).withColumn("tokens", tokens)
    rows = rows.withColumn("alone", F.when(F.size("tokens") == 0, F.struct("category", "message")))
    cond = F.lit(True)
    f = nodes.select(*[C(c).alias(f"f_{c}") for c in NODE], *[c for c in nodes.columns if c not in NODE])
    for c in ("project_id", "project_number", "discipline", "tokens"):
        cond = cond & (C(c) == C(f"f_{c}"))
    return rows.join(f, cond & C("alone").eqNullSafe(C("f_alone")))


def stored_duplicates(existing: DataFrame, incoming: DataFrame, share: float = SHARE) -> DataFrame:
    """Incoming issues that repeat a stored one of their project (by id or by number) and discipline, with the first such one."""
    nodes = written(_nodes(existing, incoming), "issue-nodes")
    near = issue_links(nodes, share).where("earlier.side = 0").groupBy("node").agg(F.min("earlier").alias("of"))
    placed = (C("project_id") != "") | (C("project_number") != "")
    own = F.when(placed & (C("node.side") == 0), C("node"))
    first = nodes.join(near, "node", "left").withColumn("of", F.least("of", own)).where("of is not null")
    return _with_nodes(incoming, first).select(C("seq").alias("incoming_seq"), C("of.seq").alias("existing_seq"))


def import_issues(existing: DataFrame, incoming: DataFrame, action: str = "skip", share: float = SHARE) -> DataFrame:
    """What becomes of each incoming issue: ``import``, or ``action`` (skip, merge) with the issue it repeats.

    Issues are taken in ``seq`` order; one repeats the first stored or already imported issue that is alike. That is the lexicographically first independent set of the links, and
    it is found in rounds: a node with an imported earlier neighbour goes, a node whose earlier neighbours are all decided and none imported stays. A round is two joins whose result is
    written to the shared folder; only the number of undecided nodes comes to the driver. Rows of one node share its fate, all but the first repeat it.
    With ``keep`` all are imported. ``seq`` is unique on each side; null fields count as empty and an issue without project id and number repeats none.
    Columns: seq, action, duplicate_side (stored or imported), duplicate_seq. Writes intermediate tables when called.
    """
    if action == "keep":
        none = F.lit(None)
        return incoming.select("seq", F.lit("import").alias("action"), none.cast("string").alias("duplicate_side"), none.cast("bigint").alias("duplicate_seq"))
    nodes = written(_nodes(existing, incoming), "issue-nodes")
    placed = (C("project_id") != "") | (C("project_number") != "")
    links = written(issue_links(nodes, share), "issue-links")
    state = written(nodes.where(placed).select("node", F.when(C("node.side") == 0, True).alias("kept")), "issue-state")
    while state.where("kept is null").limit(1).count():
        open_ = state.where("kept is null").select("node")
        near = links.join(open_, "node").join(state.select(C("node").alias("earlier"), C("kept").alias("k")), "earlier") \
            .groupBy("node").agg(F.min(F.when(C("k"), C("earlier"))).alias("first"), F.bool_or(C("k").isNull()).alias("waits"))
        later = state.join(near, "node", "left")
        decided = F.when(C("kept").isNull(), F.when(C("first").isNotNull(), False).when(~F.coalesce("waits", F.lit(False)), True)).otherwise(C("kept"))
        state = written(later.select("node", decided.alias("kept")), "issue-state")
    named = links.join(state.where("kept").select(C("node").alias("earlier")), "earlier").groupBy("node").agg(F.min("earlier").alias("of"))
    fate = nodes.join(state, "node", "left").join(named, "node", "left")
    j = _with_nodes(incoming, fate)
    first = (C("node.side") == 1) & (C("node.seq") == C("seq"))
    imported = C("kept").isNull() | (C("kept") & first)
    of = F.when(~imported, F.when(C("kept"), F.least("node", F.coalesce("of", "node"))).otherwise(C("of")))
    return j.select("seq", F.when(imported, "import").otherwise(action).alias("action"), F.when(of["side"] == 0, "stored").when(of["side"] == 1, "imported").alias("duplicate_side"), of["seq"].alias("duplicate_seq"))

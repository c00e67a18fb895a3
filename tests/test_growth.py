"""Steps that grow with the input: no row meets more than it needs, no task more than its share."""

from contextlib import contextmanager

from pyspark.sql import functions as F

from verdance.functions import units as U


@contextmanager
def setting(spark, name, value):
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def parameters():
    return F.array(F.struct(F.lit("density").alias("name"), F.lit(832.0).alias("value"), F.lit("kg/m3").alias("unit"), F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to")))


def test_rows_of_few_unit_expressions_stay_where_they_are(spark):
    """rows joined their expression by a shuffle, so most of them met in one task."""
    rows = spark.range(40).select("id", F.when(F.col("id") > 0, "kgCO2e/l").alias("a"), F.lit("kgCO2e/kg").alias("b"), F.lit(2.0).alias("v"), parameters().alias("given"))
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        out = U.convert_factor_expression(rows, "v", "a", "b", "given", F.lit("1998-01-01").cast("date"))
        assert "SortMergeJoin" not in plan(out)
        got = {r["id"]: (r["status"], r["converted"]) for r in out.collect()}
    assert got.pop(0) == ("incompatible", None)
    assert {s for s, _ in got.values()} == {"conditional_conversion"} and all(abs(v - 2.0 / 0.832) < 1e-9 for _, v in got.values())


def test_many_unit_expressions_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(U, "BROADCAST_EXPRESSIONS", 1)
    rows = spark.createDataFrame([(0, "kg/m3"), (1, "MJ/kg"), (2, None)], "id int, u string")
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        out = U.parse(rows, "u")
        assert "SortMergeJoin" in plan(out)
        assert {r["id"]: r["denominator"] for r in out.collect()} == {0: "m3", 1: "kg", 2: None}


def test_dated_conversion_stays_where_it_is(spark):
    """rows joined the unit of their parameter by a shuffle; rows without a parameter met in one task."""
    rows = spark.range(20).select("id", F.when(F.col("id") % 2 == 0, "l").otherwise("kg").alias("a"), F.lit("kg").alias("b"), F.lit(2.0).alias("v"), F.when(F.col("id") != 4, parameters()).alias("given"))
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        out = U.convert_dated(rows, "v", "a", "b", "given", F.lit("1998-01-01").cast("date"))
        assert "SortMergeJoin" not in plan(out)
        got = {r["id"]: r["converted"] for r in out.collect()}
    assert got[4] is None and abs(got[2] - 2 * 0.832) < 1e-9 and got[1] == 2.0


def test_a_request_meets_the_geographies_of_its_topic_only(spark):
    """each request was joined with every geography before its topic was looked at."""
    from verdance.operators import compare as P

    codes = [f"g{k}" for k in range(50)]
    told = "factor_id string, topic string, profiles array<string>, geo_code string, fit string, reference_year int, data_quality string, activity_unit string, source_health string, factor_boundary string, factor_methodology string, taxonomy_code string, activity_type string, name string, concept_code string"
    factors = spark.createDataFrame([(f"f{c}", "t", ["x"], c, "global", 1998, "default", "kg", "healthy", None, None, "a", "b", "c", "d") for c in codes[1:]] + [("own", "u", ["x"], "g0", "global", 1998, "default", "kg", "healthy", None, None, "a", "b", "c", "d")], told)
    closed = spark.createDataFrame([(c, c, 0) for c in codes], "requested string, candidate string, depth int")
    asked = spark.createDataFrame([(k, "u", "x", "a", codes[k % 50], 1998, "g", None, None) for k in range(1000)], "request_id long, topic string, profile string, activity string, country string, year int, unit string, boundary string, methodology string")
    for alike in (True, False):
        with setting(spark, "spark.sql.adaptive.enabled", "false"):
            found = P.class_match(asked, factors, closed, 1, True, alike)
            got = found.collect()
        assert len(got) == 1000 and {r["factor_id"] for r in got} == {"own"}
        assert {r["fallback_rank"] for r in got if r["request_id"] % 50 == 0} == {0} and {r["fallback_rank"] for r in got if r["request_id"] % 50} == {P.PROXY_RANK}
        assert rows_out(found) < 30_000


def rows_out(frame):
    """The most rows that an operator of a plan that has run put out."""
    most, left = 0, [frame._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        metric = node.metrics().get("numOutputRows")
        most = max(most, metric.get().value() if metric.isDefined() else 0)
        left.extend(node.children().apply(i) for i in range(node.children().size()))
    return most


def test_the_last_year_is_found_before_texts_are_joined(spark):
    """names and types of parts moved through the window of the last year."""
    from verdance.plans.catalogue import factor_versions

    text = factor_versions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Join") < text.index("Window")


def test_texts_whose_common_letters_are_few_are_not_matched(monkeypatch):
    """matching blocks were computed for all pairs of texts that share enough pairs of letters."""
    import random
    from difflib import SequenceMatcher

    from verdance.operators import resolver as R

    rng, matched = random.Random(3), []
    monkeypatch.setattr(R, "SequenceMatcher", lambda junk, x, y: matched.append(1) or SequenceMatcher(junk, x, y))
    texts = ["".join(rng.choice(["th", "er", "in", "on", " "]) for _ in range(rng.choice([3, 40, 150]))) for _ in range(30)]
    texts += [t[:20] + "xy" + t[22:] for t in texts[:10]]
    for x in texts:
        for y in texts:
            ratio = SequenceMatcher(None, x, y).ratio()
            assert R.ratio_of(x, y) == (ratio if ratio >= 0.82 else None)
    assert len(matched) < len(texts) ** 2 / 2
    assert R.common_letters("abcbdab", "bdcaba") == 4 and R.common_letters("", "a") == 0


def test_pages_are_parsed_once(spark):
    """headers and places were two branches, each of which parsed every page."""
    from verdance.sources import html_tables as H

    pages = spark.createDataFrame([(1, "<table><tr><th>a<th>b<tr><td>1<td>2<tr><td>3</table><table><tr><td>9</table>")], "page_id long, html string")
    facts = H.table_facts(H.html_grid(pages))
    assert facts._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {(r["table_no"], r["row"], r["col"]): (r["header"], r["text"]) for r in facts.collect()}
    assert got == {(0, 1, 0): ("a", "1"), (0, 1, 1): ("b", "2"), (0, 2, 0): ("a", "3"), (1, 0, 0): (None, "9")}


def test_equal_requests_are_ranked_once(spark):
    """each request met all classes of factors that its words and its country's chain reach."""
    from verdance.operators import search as E

    texts = "factor_id string, name string, description string, taxonomy_code string, activity_type string, concept_code string, application string, geo_code string, fit string, reference_year int, data_quality string, activity_unit string, is_primary boolean, is_derived boolean"
    places = [("FR", "country_specific"), ("EU", "regional"), ("GLOBAL", "global")]
    rows = [(f"f{k:03d}", "red ring", None, f"t{k}", "b", "c", None, *places[k % 3], 1998, "default", "kg", k % 7 == 0, k % 2 == 1) for k in range(60)]
    closed = spark.createDataFrame([("FR", "FR", 0), ("FR", "EU", 1), ("FR", "GLOBAL", 2)], "requested string, candidate string, depth int")
    asked = spark.createDataFrame([(k, "red", ["red"], ["x"], "kg", 1998, "FR" if k % 2 else None, True) for k in range(400)], "request_id long, query string, terms array<string>, query_concepts array<string>, unit string, year int, country string, allow_conditional boolean")
    with setting(spark, "spark.sql.adaptive.enabled", "false"):
        found = E.search(asked, spark.createDataFrame(rows, texts), closed, 2)
        got = found.collect()
    by = {k: sorted((r["rank"], r["factor_id"]) for r in got if r["request_id"] == k) for k in (0, 1, 398, 399)}
    assert by[0] == by[398] == [(1, "f000"), (2, "f001")] and by[1] == by[399] == [(1, "f000"), (2, "f003")] and len(got) == 800
    assert rows_out(found) < 5_000  # the grams of the texts; all pairs are 24,000


def test_candidates_come_from_cells_and_equal_all_pairs(spark):
    """each kind of request met every factor of its family in its country's chain."""
    import random

    from verdance.operators import search as E

    rng = random.Random(5)
    pick = rng.choice
    factors = [(f"f{k:03d}", f"l{rng.randrange(150)}", pick(["waste", "diesel"]), pick(["FR", "DE", "EU", "GLOBAL"]), pick(["glass waste", "paper", "mixed"]), pick(["a.b", "c"]), pick([0, 2, 3]), pick([1990, 1995, 1998, None])) for k in range(300)]
    chain = [("FR", "FR"), ("FR", "EU"), ("FR", "GLOBAL"), ("DE", "DE"), ("DE", "EU"), ("DE", "GLOBAL")]
    asked = [(k, pick(["waste", "diesel"]), pick(["FR", "DE"]), pick([["glass"], ["waste", "mixed"], []]), pick([[], ["A"], ["x"]]), pick([1994, 1999, None])) for k in range(60)]
    want = set()
    for k, family, country, tokens, hints, year in asked:
        best = {}
        for f, logical, own, code, name, taxonomy, specificity, y in factors:
            fits = family != "waste" or (any(taxonomy.startswith(h.lower()) for h in hints) if hints else any(t in name for t in tokens) or not tokens)
            if own == family and (country, code) in chain and fits:
                order = (0 if year is None or y is None else abs(year - y), -(y or 0), f)
                best[logical] = min(best.get(logical, (order, f, specificity, y)), (order, f, specificity, y), key=lambda x: x[0])
        first = sorted((-s, y is None, -(y or 0), logical, f) for logical, (_, f, s, y) in best.items())[:3]
        want |= {(k, x[-1], i + 1) for i, x in enumerate(first)}
    frames = spark.createDataFrame(asked, "request_id long, want_family string, country string, tokens array<string>, hints array<string>, year int"), spark.createDataFrame(factors, "factor_id string, logical_id string, family string, geo_code string, name string, taxonomy_code string, specificity int, reference_year int")
    got = {tuple(r) for r in E.recommendation_candidates(*frames, spark.createDataFrame(chain, "requested string, candidate string"), keep=3).select("request_id", "factor_id", "position").collect()}
    assert got == want and len(want) > 100
    single = spark.range(3000).select(F.format_string("f%05d", "id").alias("factor_id"), F.format_string("l%05d", "id").alias("logical_id"), F.lit("diesel").alias("family"), F.lit("GLOBAL").alias("geo_code"), F.lit("n").alias("name"), F.lit("t").alias("taxonomy_code"), F.lit(0).alias("specificity"), F.lit(1998).alias("reference_year"))
    kinds = spark.createDataFrame([(k, "diesel", f"c{k}", [], [], 1998) for k in range(40)], frames[0].schema)
    everywhere = spark.createDataFrame([(f"c{k}", "GLOBAL") for k in range(40)], "requested string, candidate string")
    with setting(spark, "spark.sql.adaptive.enabled", "false"):
        found = E.recommendation_candidates(kinds, single, everywhere, keep=3)
        assert len(found.collect()) == 120
    assert rows_out(found) < 10_000


def test_batch_match_counts_without_sorting(spark):
    """matches and rejections were ranked in two windows over all pairs, each of which scored them."""
    from verdance.operators import matching as M

    rows = [(r, f"f{r}-{k:02d}", k % 3 == 0, ["unit_incompatible"] if k % 5 == 4 else ["source_missing"] if k % 7 == 6 else [], k % 2, k) for r in range(4) for k in range(5 + 15 * r)]
    scored = spark.createDataFrame(rows, "request_id long, factor_id string, eligible boolean, reasons array<string>, fallback_rank int, score int")
    got = M.batch_match(spark.range(5).withColumnRenamed("id", "request_id"), scored)
    assert "Window" not in plan(got)
    ranks = {r: [x["factor_id"] for x in sorted(M.match(scored).where(F.col("request_id") == r).collect(), key=lambda x: x["rank"])] for r in range(4)}
    soft = {r["request_id"]: r["count"] for r in M.rejected(scored).groupBy("request_id").count().collect()}
    want = {(r, "matched", ranks[r][0], len(ranks[r]) - 1, soft[r]) for r in range(4)} | {(4, "no_calculation_eligible_candidate", None, 0, 0)}
    assert {tuple(x) for x in got.collect()} == want and max(soft.values()) == 20


def test_forms_made_once_give_the_same_scores(spark):
    """normal forms of all texts were made for each pair of request and factor."""
    from verdance.operators import matching as M

    words = ["Natural-Gas", "natural gas liquids", "Red  wood", "wood", "", None]
    labels = spark.createDataFrame([("energy.natural_gas", "Natural gas!", 0), ("wood", "red wood", 1)], "concept string, label string, position int")
    asked = M.resolved_activities(spark.createDataFrame([(w,) for w in words], "activity string"), labels).withColumns({"year": F.lit(1999), "boundary": F.lit("x"), "methodology": F.lit(None).cast("string"), "unit_status": F.lit("exact_conversion")})
    factors = spark.createDataFrame([(a, b, "Wood", b, q, 1995) for a in words for b in words for q in ("Official annual", None)], "taxonomy_code string, name string, activity_type string, concept_code string, data_quality string, reference_year int").withColumns({x: F.lit("x") for x in ("source_health", "fit", "factor_boundary", "factor_methodology")})
    told = ["activity", "taxonomy_code", "name", "data_quality", "score_activity", "score_year", "score_data_quality", "score"]
    plain, formed = (M.scored_candidates(a.crossJoin(b)).select(*told) for a, b in ((asked, factors), (M.with_forms(asked), M.with_forms(factors))))
    assert plain.exceptAll(formed).isEmpty() and formed.count() == plain.count() == 432
    assert "regexp_replace" not in formed._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_current_versions_are_one_maximum(spark):
    """Current versions were found by a window over all versions."""
    from verdance.operators import catalog as C
    from verdance.plans.catalogue import factor_versions

    every, last = (C.published_and_current(factor_versions(spark, "/root/testdata/sf0.001", current=x)) for x in (False, True))
    assert "Window" not in plan(last) and every.schema == last.schema
    assert every.exceptAll(last).isEmpty() and last.exceptAll(every).isEmpty() and not last.isEmpty()


def test_texts_of_parts_are_classified_once(spark):
    """Families of texts were joined to each factor and each request."""
    from verdance.plans import policy_queries as P

    for frame in (P._factors(spark, "/root/testdata/sf0.001"), P._requests(spark, "/root/testdata/sf0.001")):
        text = frame._jdf.queryExecution().optimizedPlan().toString()
        below = [line for line in text.splitlines() if "LeftOuter" in line]
        depth = min(line.index("Join") for line in text.splitlines() if "Join Inner" in line)
        assert below and all(line.index("Join") > depth for line in below)


def test_a_formula_is_cut_into_tokens_once(spark):
    """F8: the end of a formula mentioned its tokens, so they were cut again for each mention; each step copied arrays."""
    from verdance.sources import science as N

    rows = spark.createDataFrame([(0, "e = -a * (b + 2) ^ c"), (1, ""), (2, "a )"), (3, "+"), (4, None)], "id int, f string")
    out = rows.select("id", N.parsed_formula(F.col("f")).alias("p"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(translate") == 1
    got = {r["id"]: r["p"] and (r["p"]["postfix"], r["p"]["symbols"], r["p"]["finding"]) for r in out.collect()}
    assert got[0] == (["a", "u-", "b", "2", "+", "c", "^", "*"], ["a", "b", "c"], None)
    assert [got[k] for k in (1, 2, 3, 4)] == [(None, None, "empty"), (None, None, "unbalanced"), (None, None, "missing_operand"), None]


def test_the_nearest_year_is_found_without_sorting_versions(spark, tmp_path):
    """all versions of all years were moved and sorted to keep one of each logical id."""
    from verdance.operators import catalog as C
    from verdance.plans import queries as Q
    from verdance.plans.catalogue import factor_versions

    base = "/root/testdata/sf0.001"
    years = {1: [1996, 2000], 2: [1997, 1999], 3: [None, 2001], 4: [None], 5: [1998, 1998], 6: [1990, 2010]}
    made = [(p, 1, None if y is None else f"{y}-05-01", cost) for p, ys in years.items() for y, cost in zip(ys, (10.25, -3.5))]
    spark.createDataFrame(made, "l_partkey long, l_suppkey long, d string, l_extendedprice double").withColumn("l_shipdate", F.col("d").cast("timestamp")).write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("supplier", "part", "nation", "region"):
        spark.read.parquet(f"{base}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for folder in (str(tmp_path), base):
        rows = factor_versions(spark, folder, nearest=1998)
        want = C.nearest_year(factor_versions(spark, folder), F.lit(1998), ["logical_id"], [F.col("factor_id")])
        assert rows.columns == want.columns and rows.exceptAll(want).isEmpty() and want.exceptAll(rows).isEmpty()
    assert "Window" not in plan(Q.nearest_year_version(spark, base))
    got = {r["l_partkey"]: (r["reference_year"], r["version_status"]) for r in factor_versions(spark, str(tmp_path), nearest=1998).collect()}
    assert got == {1: (1996, "superseded"), 2: (1997, "superseded"), 3: (2001, "current"), 4: (None, got[4][1]), 5: (1998, "current"), 6: (1990, "superseded")}


def test_unmapped_factors_need_no_index(spark):
    """the whole concept index was built and joined to find what it lacks; sources of one name multiplied its rows."""
    from verdance.operators import index as I
    from verdance.plans import serving_queries as S

    rows = [("a", "s1", "t", "blue ring", "current"), ("b", "s2", "t", "blue ring", "current"), ("c", "s2", "t", "blue ring", "superseded"), ("d", "s2", None, "x", "current"), ("e", "s3", None, "x", "current"), ("f", None, "t", "x", "current")]
    factors = spark.createDataFrame([(*r, "k") for r in rows], "factor_id string, source_code string, taxonomy_code string, name string, version_status string, activity_type string")
    mapping = spark.createDataFrame([("s1", "t", "m")] * 3 + [("s3", "", "n")], "source_code string, taxonomy_code string, concept string")
    labels = spark.createDataFrame([("l", "UE RI"), ("l2", "ue ri"), ("l3", None)], "concept string, label string")
    index = I.concept_index(factors, mapping, labels)
    assert sorted(r["factor_id"] for r in I.unmapped(factors, mapping, labels).collect()) == ["c", "d", "f"] == sorted(r["factor_id"] for r in factors.join(index, "factor_id", "left_anti").collect())
    assert I.taxonomy_concepts(factors, mapping).count() == 2
    text = plan(S.unmapped_factors(spark, "/root/testdata/sf0.001"))
    assert text.count("lineitem.parquet") <= 2


def test_equal_lines_stay_apart_when_reattached(spark, tmp_path):
    """lines went by a text of their columns and a digest, moved with both; of equal lines one was left."""
    from verdance.plans import serving_queries as S

    lines = [(1, 2, 7, 1, 3.0, "A", "O"), (1, 2, 7, 1, 3.0, "A", "O"), (1, 1, 9, 1, 4.0, "R", "F"), (2, 1, 1, 1, 5.0, "N", "O"), (3, 1, 1, 1, 5.0, "N", "O")]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1,), (2,), (4,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert {tuple(r) for r in S.reattached_rows(spark, str(tmp_path)).collect()} == {(1, "RF4,AO3,AO3"), (2, "NO5")}


def test_a_part_of_the_versions_is_written_by_one_task(spark, tmp_path):
    """each task wrote a file into each part that it held rows of."""
    from verdance.streaming import ingest

    rows = spark.range(400).select(
        F.concat(F.lit("v"), "id").alias("version_id"), F.concat(F.lit("l"), "id").alias("logical_id"), F.concat(F.lit("s"), F.col("id") % 2).alias("source_code"), (F.col("id") % 3 + 1997).cast("int").alias("reference_year"),
        *(F.lit(None).cast(t).alias(c) for c, t in (("valid_from", "date"), ("valid_to", "date"), ("version_status", "string"), ("system_effective_from", "timestamp"), ("system_effective_to", "timestamp"))),
    )
    rows.write.parquet(f"{tmp_path}/landing")
    empty = spark.createDataFrame([], rows.schema).withColumn("supersedes_version_id", F.lit(None).cast("string"))
    with setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        ingest.superseding(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/landing"), empty, f"{tmp_path}/table", f"{tmp_path}/checkpoint").start().awaitTermination()
    folders = [p for p in (tmp_path / "table" / "data").rglob("part=*") if p.is_dir()]
    assert len(folders) == 6 and all(len(list(p.glob("*.parquet"))) == 1 for p in folders)
    assert ingest.state(spark, f"{tmp_path}/table", empty.schema).count() == 400


def test_alternatives_are_ranked_once_for_factors_that_ask_the_same(spark):
    """every factor was joined with five rows, which were moved and sorted again to leave the factor itself out."""
    from verdance.operators import compare as P

    told = "factor_id string, profiles array<string>, geo_code string, fit string, reference_year int, data_quality string, activity_unit string, source_health string, taxonomy_code string"
    factors = spark.createDataFrame([(f"f{k:02}", ["x"], "g0" if k < 3 else "g1", "global", 1998, "default", "kg", "healthy", "a") for k in range(9)] + [("alone", ["y"], "g0", "global", 1998, "default", "kg", "healthy", "a")], told)
    closed = spark.createDataFrame([("g0", "g0", 0), ("g0", "g1", 1), ("g1", "g1", 0)], "requested string, candidate string, depth int")
    out = P.alternatives(factors, closed, 4)
    found = {}
    for r in out.collect():
        found.setdefault(r["factor_id"], {})[r["rank"]] = r["alternative_id"]
    assert found["f01"] == {1: "f00", 2: "f02", 3: "f03", 4: "f04"} and found["f03"] == {1: "f04", 2: "f05", 3: "f06", 4: "f07"} and found["f08"] == {1: "f03", 2: "f04", 3: "f05", 4: "f06"} and "alone" not in found
    assert not [x for x in plan(out).split("\n") if "Window " in x and "request_id" in x]


def test_lists_of_candidates_are_whole(spark, monkeypatch):
    """a request's list ended after its third candidate."""
    import random

    from verdance.operators import search as E

    monkeypatch.setattr(E, "PIECE", 7)
    rng = random.Random(7)
    factors = [(f"f{k:03d}", f"l{rng.randrange(250)}", "diesel", rng.choice(["FR", "GLOBAL"]), "n", "t", rng.choice([0, 2, 3]), rng.choice([1990, 1995, None])) for k in range(300)]
    best = {}
    for f, logical, _, _, _, _, specificity, y in factors:
        best.setdefault(logical, []).append((-(y or 0), f, specificity, y))
    first = sorted((-s, y is None, -(y or 0), logical, f) for logical, held in best.items() for _, f, s, y in [min(held)])
    asked = [(k, "diesel", "FR", [], [], None) for k in range(40)] + [(40, "waste", "FR", [], [], None)]
    want = {(k, x[-1], i) for k in range(40) for i, x in enumerate(first, 1)}
    frames = spark.createDataFrame(asked, "request_id long, want_family string, country string, tokens array<string>, hints array<string>, year int"), spark.createDataFrame(factors, "factor_id string, logical_id string, family string, geo_code string, name string, taxonomy_code string, specificity int, reference_year int")
    got = [tuple(r) for r in E.recommendation_candidates(*frames, spark.createDataFrame([("FR", "FR"), ("FR", "GLOBAL")], "requested string, candidate string")).select("request_id", "factor_id", "position").collect()]
    assert set(got) == want and len(got) == len(want) > 4_000


def test_variants_are_not_moved_for_their_results(spark):
    """variants of requests were moved to what they found, to its values and to their base."""
    from verdance.operators import compare as P

    factors = [(f"f{t}-{g}", f"t{t}", ["corporate"] if t else ["corporate", "lca"], g, fit, 1998, "default", "kg", "healthy", None, None, f"t{t}", "b", "n", "c", 2.0 + t) for t in range(3) for g, fit in (("FR", "country_specific"), ("GLOBAL", "global"))]
    names = "factor_id string, topic string, profiles array<string>, geo_code string, fit string, reference_year int, data_quality string, activity_unit string, source_health string, factor_boundary string, factor_methodology string, taxonomy_code string, activity_type string, name string, concept_code string, factor_value double"
    requests = [(k, f"t{k % 4}", "corporate", "b", "FR" if k % 2 else "DE", 1998, "kg", None, None, float(k)) for k in range(200)]
    asked = spark.createDataFrame(requests, "request_id long, topic string, profile string, activity string, country string, year int, unit string, boundary string, methodology string, quantity double")
    closed = spark.createDataFrame([(x, y, d) for x in ("FR", "DE") for y, d in ((x, 0), ("GLOBAL", 1))], "requested string, candidate string, depth int")
    changes = [{}, {"country": F.lit("FR")}, {"unit": F.lit("g")}, {"profile": F.lit("lca")}]
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"), setting(spark, "spark.sql.adaptive.enabled", "false"):
        found = P.compared(asked, changes, spark.createDataFrame(factors, names), closed)
        tree = plan(found)
        got = {(r["request_id"], r["variant"]): (r["status"], r["factor_id"], r["emissions"], r["difference"]) for r in found.collect()}
    top = tree[: tree.index("collect_list")]
    assert top.count("Exchange hashpartitioning") == 1  # that of the requests; their variants' rows stay with them
    assert len(got) == 800
    for k, topic, _, _, country, *_ in requests:
        t = k % 4
        for v in range(4):
            if t == 3 or (v == 3 and t):
                assert got[k, v] == ("no_eligible_data", None, None, None)
                continue
            base, of = k * (2.0 + t), k * (2.0 + t) * (0.001 if v == 2 else 1)
            place = "FR" if country == "FR" or v == 1 else "GLOBAL"
            status, factor, emissions, difference = got[k, v]
            assert (status, factor) == ("calculated", f"f{t}-{place}") and abs(emissions - of) < 1e-9 and abs(difference - (of - base)) < 1e-9

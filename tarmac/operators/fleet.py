"""Aircraft, their components, and which directives apply to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.text import optional_text
from tarmac.operators.applicability import CLOSE, Applicability, close_class_links
from tarmac.streaming.folders import shared_folder


def components_long(aircraft: DataFrame) -> DataFrame:
    """Wide aircraft facts as one row per component: the airframe always, others where a make, model or serial is given.

    Columns that the table lacks (engine_serial, propeller_model, propeller_serial) count as null.
    """
    given = lambda c: optional_text(F.col(c)) if c in aircraft.columns else F.lit(None).cast("string")
    one = lambda role, make, model, serial: F.struct(F.lit(role).alias("role"), given(make).alias("make"), given(model).alias("model"), given(serial).alias("serial"))
    facts = F.array(one("airframe", "make", "model", "serial"), one("engine", "engine_make", "engine_model", "engine_serial"), one("propeller", "propeller_make", "propeller_model", "propeller_serial"))
    some = lambda c: (c["role"] == "airframe") | c["make"].isNotNull() | c["model"].isNotNull() | c["serial"].isNotNull()
    rows = aircraft.select("aircraft_id", F.explode(F.filter(facts, some)).alias("c"))
    return rows.select("aircraft_id", "c.*").withColumn("display_name", F.concat_ws(" ", "make", "model", "serial"))


def component_targets(components: DataFrame, targets: DataFrame) -> DataFrame:
    """(aircraft_id, directive_id, role) by a compatible role and equal make and model; a null on the target's side fits all."""
    return Applicability.of(components, targets).pairs()


def uncertain_components(components: DataFrame, targets: DataFrame, least: int = CLOSE) -> DataFrame:
    """(aircraft_id, directive_id) of both branches, for all roles: close make and model, or one that the target names and the component lacks."""
    return Applicability.of(components, targets, lambda a, d: close_class_links(a, d, least)).pairs(first=True).select("aircraft_id", "directive_id")


def coverage_sets(targets: DataFrame) -> DataFrame:
    """Per target: directives that are current, publications, bytes of their canonical text, and a status."""
    text = F.concat_ws("|", F.col("directive_id").cast("string"), "ad_number", "title")
    out = targets.groupBy("target_key").agg(
        F.countDistinct(F.when(F.col("source_status") == "current", F.col("directive_id"))).alias("directives"),
        F.countDistinct("ad_number").alias("publications"), F.sum(F.octet_length(text)).alias("source_bytes"),
        F.count_if(F.col("source_status") == "in_review").alias("open"),
    )
    status = F.when(F.col("open") > 0, "degraded").when(F.col("directives") == 0, "pending").otherwise("current")
    return out.select("target_key", "directives", "publications", "source_bytes", status.alias("status"))


def coverage_status(components: DataFrame, covered: DataFrame) -> DataFrame:
    """Per aircraft the roles without a covered target, as a sorted list, and a status."""
    gaps = components.join(covered, ["role", "make"], "left_anti").groupBy("aircraft_id").agg(F.array_sort(F.collect_set("role")).alias("gaps"))
    out = components.groupBy("aircraft_id").agg(F.count("*").alias("components")).join(gaps, "aircraft_id", "left")
    status = F.when(F.size(F.coalesce("gaps", F.array())) == 0, "current").when(F.size("gaps") < F.col("components"), "degraded").otherwise("not_resolved")
    return out.select("aircraft_id", "components", F.coalesce(F.array_join("gaps", ","), F.lit("")).alias("gaps"), status.alias("status"))


#: Words that count as an action of any directive.
ACTION_WORDS = ("comply", "complied", "compliance", "inspect", "inspection", "replace", "replaced", "modify", "modified")


def _prefix_words(directives: DataFrame, seen: DataFrame) -> DataFrame:
    """(directive_id, word, potential): each directive's words that some entry has, with the most that this word and all more frequent ones can add to a score.

    An entry that needs n points of words and has none of the words with a potential of n
    or more has only such that add less than n together. It thus meets the directive at a
    rare word or not at all.
    """
    part = lambda c: F.array_contains(c, F.col("word")).cast("int")
    own = F.array_except("action_words", F.array(*map(F.lit, ACTION_WORDS)))
    words = directives.withColumn("_own", own).withColumn("word", F.explode(F.array_union(F.array_union("product_words", "title_words"), "_own")))
    words = words.select("directive_id", "word", part("product_words").alias("p"), part("title_words").alias("t"), part("_own").alias("o"))
    # Spark takes the exploded words for as small as the directives' file, and would send them all through the driver.
    words = words.join(seen.hint("merge"), "word")
    down = Window.partitionBy("directive_id").orderBy(F.desc("entries"), "word").rowsBetween(Window.unboundedPreceding, 0)
    points = F.least(40 * F.sum("p").over(down), F.lit(160)) + F.least(25 * F.sum("t").over(down), F.lit(100)) + F.least(40 * F.sum("o").over(down), F.lit(180))
    return words.select("directive_id", "word", points.alias("potential"))


def candidate_evidence(entries: DataFrame, directives: DataFrame, applicable: Applicability | DataFrame, top: int = 5) -> DataFrame:
    """The best entries for each applicable (aircraft_id, directive_id), with confidence, disposition and place.

    In thousandths: 820 for a citation that says complied or inspected, 450 for any other
    or for the bare number, and for each shared word 40 of products (160 at most), 40 of
    actions (180) and 25 of the title (100), 950 in all; 200 or more are kept. An entry
    meets a directive by its number, or by one of the directive's rare words in a class of
    the entry's aircraft that the directive applies to, where all frequent ones together
    would not do; pairs of aircraft and directives are never listed. Of equal scores the
    latest entry comes first. directives: directive_id, ad_number, title, products,
    actions. applicable: classes, or pairs. Rows repeated in full count once.
    """
    from tarmac.functions.maintenance import directive_references
    from tarmac.functions.text import keywords

    if isinstance(applicable, DataFrame):
        applicable = Applicability.of_pairs(applicable)
    spark, root = entries.sparkSession, shared_folder(entries.sparkSession, "evidence")
    applicable = applicable.written(root)
    none = F.array().cast("array<string>")
    shown, key = ["aircraft_id", "entry_id", "line_no", "entry_date", "quantity", "body"], ["aircraft_id", "_row"]
    e = entries.where("review_status = 'verified' and entry_date is not null").select(*shown).distinct()
    e = e.withColumn("_row", F.md5(F.to_json(F.struct(*shown), {"ignoreNullFields": "false"})))
    terms = lambda c: keywords(F.concat_ws(" ", F.coalesce(c, none)))
    d = directives.select(
        "directive_id", "ad_number", terms(F.col("products")).alias("product_words"), keywords(F.col("title")).alias("title_words"),
        F.array_union(terms(F.col("actions")), F.array(*map(F.lit, ACTION_WORDS))).alias("action_words"),
    )
    e = e.withColumn("entry", F.struct(*shown))
    cited = e.select(*key, "entry", "body").withColumn("_refs", directive_references(F.col("body"), "ad_number", "disposition"))
    # Of a number cited twice the first citation counts.
    cited = cited.withColumn("_refs", F.filter("_refs", lambda x, i: ~F.exists(F.slice("_refs", F.lit(1), i), lambda y: y["ad_number"] == x["ad_number"])))
    bare = F.array_distinct(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit("(?=([0-9]{4}-[0-9]{2}-[0-9]{2}))"), F.lit(1)))
    said = F.transform("_refs", lambda x: F.struct(x["ad_number"].alias("ad_number"), x["disposition"].alias("disposition")))
    other = F.transform(F.array_except(bare, F.transform("_refs", lambda x: x["ad_number"])), lambda n: F.struct(n.alias("ad_number"), F.lit(None).cast("string").alias("disposition")))
    # Outer, as Spark would read all citations once more to see whether there are any. Tables of members and directives are far larger in memory than their files, so the driver must not take them for small ones.
    named = cited.select(*key, "entry", F.explode_outer(F.concat(said, other)).alias("m")).where("m is not null").select(*key, "entry", "m.*").join(d.select("directive_id", "ad_number").hint("merge"), "ad_number")
    named = applicable.among(named.select(*key, "directive_id", "disposition", F.lit(True).alias("named"), "entry"))

    said = e.select(*key, keywords(F.col("body")).alias("_w"))
    said = said.withColumn("need", 200 - F.least(40 * F.size(F.array_intersect("_w", F.array(*map(F.lit, ACTION_WORDS)))), F.lit(180)))
    spoken = said.select(*key, "need", F.explode_outer("_w").alias("word")).where("word is not null")
    rare = _prefix_words(d, spoken.groupBy("word").agg(F.count("*").alias("entries")))
    rare = rare.where(F.col("potential") >= said.agg(F.min("need")).scalar())
    by_class = rare.join(applicable.of_directives.select("directive_id", "target_class").distinct().hint("merge"), "directive_id").join(applicable.links, "target_class")
    by_class = by_class.select("component_class", "word", "directive_id", "potential").distinct()
    # Written first, so that its size is known when the entries' words meet it: where few directives can be met by words alone, these are not shuffled.
    by_class.write.parquet(f"{root}/rare")
    by_class = spark.read.schema(by_class.schema).parquet(f"{root}/rare")
    classed = spoken.join(applicable.of_aircraft.select("aircraft_id", "component_class").distinct().hint("merge"), "aircraft_id")
    worded = classed.join(by_class, ["component_class", "word"]).where("potential >= need").select(*key, "directive_id").distinct()

    both = named.unionByName(worded.join(e.select("_row", "entry"), "_row").select(*key, "directive_id", F.lit(None).cast("string").alias("disposition"), F.lit(False).alias("named"), "entry"))
    met = both.groupBy(*key, "directive_id").agg(F.max("disposition").alias("disposition"), F.bool_or("named").alias("named"), F.first("entry").alias("entry"))
    met = met.join(d.hint("merge"), "directive_id").select("*", *(f"entry.{c}" for c in shown if c != "aircraft_id")).withColumn("_w", keywords(F.col("body")))
    points = lambda c, each, most: F.least(each * F.size(F.array_intersect("_w", c)), F.lit(most))
    claim = F.when(F.col("disposition").isin("complied", "inspected"), 820).when(F.col("named"), 450).otherwise(0)
    score = F.least(claim + points("product_words", 40, 160) + points("action_words", 40, 180) + points("title_words", 25, 100), F.lit(950))
    ranked = met.withColumn("_score", score).where("_score >= 200")
    ranked = ranked.select("aircraft_id", "directive_id", "entry_id", "line_no", "entry_date", "quantity", "disposition", (F.col("_score") / 1000).cast("decimal(4,3)").alias("confidence"))
    order = Window.partitionBy("aircraft_id", "directive_id").orderBy(F.desc("confidence"), F.desc("entry_date"), F.desc("entry_id"), F.desc("line_no"), F.desc("quantity"))
    return ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def applicability_decision(pairs: DataFrame, structured: DataFrame, hits: DataFrame, uncertain: DataFrame, text_matches: DataFrame) -> DataFrame:
    """Each pair's decision: a directive with structured targets applies by a hit, else is uncertain or skipped; one without applies by its product text."""
    key = ["aircraft_id", "directive_id"]
    flag = lambda df, on, name: df.select(*on).distinct().withColumn(name, F.lit(True))
    out = pairs.select(*key).distinct().join(flag(structured, ["directive_id"], "_s"), "directive_id", "left")
    for df, name in ((hits, "_h"), (uncertain, "_u"), (text_matches, "_t")):
        out = out.join(flag(df, key, name), key, "left")
    by_target = F.when(F.col("_h"), "applicable").when(F.col("_u"), "uncertain").otherwise("skipped")
    return out.select(*key, F.when(F.col("_s"), by_target).when(F.col("_t"), "applicable").otherwise("skipped").alias("decision"))


def best_component(hits: Applicability | DataFrame, components: DataFrame) -> DataFrame:
    """Of each (aircraft_id, directive_id) the first component, by role, that a target fits, and whether its serial is known.

    hits: pairs, or the classes that they are made from, which spares a shuffle of the pairs.
    """
    serial = serials(components)
    if isinstance(hits, Applicability):
        return hits.pairs(first=True, aircraft=serial).select("aircraft_id", "role", "directive_id", "serial_known")
    return hits.groupBy("aircraft_id", "directive_id").agg(F.min("role").alias("role")).join(serial, ["aircraft_id", "role"])


def serials(components: DataFrame) -> DataFrame:
    """(aircraft_id, role, serial_known) of components of a known aircraft and role."""
    return components.where("aircraft_id is not null and role is not null").select("aircraft_id", "role", F.col("serial").isNotNull().alias("serial_known"))

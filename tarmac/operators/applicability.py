"""Which directives apply to which aircraft, between classes of alike components and alike targets.

Components of one role, make and model fit the same targets, so the joins are between
distinct classes, and their rows grow with the makes and models that there are. Pairs of
aircraft and directives come from the members of linked classes, for the pairs or the side
that a consumer asks for; all pairs are made from blocks of members, so that what is
shuffled grows with the members.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.functions.text import component_role, match_text, optional_text
from tarmac.streaming.folders import shared_folder

#: Roles of components that may answer a target's role, where these are not just the same one.
_COMPATIBLE = {
    "airframe": ["airframe", "rotorcraft_airframe"], "rotorcraft_airframe": ["airframe", "rotorcraft_airframe"],
    "propeller": ["propeller", "rotor_system"], "rotor_system": ["rotor_system", "propeller"], "appliance": ["appliance", "other", "unknown"],
    "unknown": ["airframe", "engine", "propeller", "rotorcraft_airframe", "rotor_system", "drivetrain_transmission", "appliance", "other", "unknown"],
}
#: Fewest letters of a name that another may begin with and count as close.
CLOSE = 4
#: Aircraft and directives of a block on average: a row of one side is repeated for each block of the other that it meets. Those of directives stay below the 4,096 rows of a key that a merge join holds in memory.
AIRCRAFT_BLOCK, DIRECTIVE_BLOCK = 8192, 2048


def installed(components: DataFrame) -> DataFrame:
    """Components that have not been removed."""
    return components.where("removed_at is null")


def component_members(components: DataFrame) -> DataFrame:
    """(aircraft_id, role, component_class): the class is role|make|model, names as letters and digits."""
    return components.select("aircraft_id", "role", F.concat_ws("|", "role", match_text(F.col("make")), match_text(F.col("model"))).alias("component_class")).distinct()


def target_members(targets: DataFrame) -> DataFrame:
    """(directive_id, role, target_class) of open targets, one row for each role of a component that may answer theirs."""
    role = component_role(F.col("product_type"), F.lit(None).cast("string"))
    roles = F.array(role)
    for name, fit in _COMPATIBLE.items():
        roles = F.when(role == name, F.array(*map(F.lit, fit))).otherwise(roles)
    t = targets.where("source_status in ('current', 'active', 'unknown')").withColumn("role", F.explode(roles))
    return t.select("directive_id", "role", F.concat_ws("|", "role", match_text(F.col("make")), match_text(F.col("model"))).alias("target_class")).distinct()


def _classes(members: DataFrame, name: str, make: str, model: str) -> DataFrame:
    part = lambda i: F.get(F.split(name, r"\|"), F.lit(i))
    return members.select(name).distinct().select(name, part(0).alias("role"), part(1).alias(make), part(2).alias(model))


def class_links(of_aircraft: DataFrame, of_directives: DataFrame) -> DataFrame:
    """(component_class, target_class) of equal role, make and model; a name that the target lacks fits all.

    The wildcard is a union of four equal joins, as an OR would be a nested loop.
    """
    c, t = _classes(of_aircraft, "component_class", "make", "model"), _classes(of_directives, "target_class", "make", "model")
    out = None
    for any_make in (False, True):
        for any_model in (False, True):
            keys = ["role", *(["make"] if not any_make else []), *(["model"] if not any_model else [])]
            part = t.where((F.col("make") == "") == any_make).where((F.col("model") == "") == any_model).select("target_class", *keys)
            hits = c.join(part, keys).select("component_class", "target_class")
            out = hits if out is None else out.unionAll(hits)
    return out


def close_class_links(of_aircraft: DataFrame, of_directives: DataFrame, least: int = CLOSE) -> DataFrame:
    """(component_class, target_class) that may fit: the target names what the component lacks, or both names begin alike and differ.

    Each alternative is an equal join: by role and what both sides lack, or by role and the first letters of the make.
    """
    c, t = _classes(of_aircraft, "component_class", "cm", "cd"), _classes(of_directives, "target_class", "tm", "td")

    def close(a: str, b: str):
        a, b = F.col(a), F.col(b)
        return (F.least(F.length(a), F.length(b)) >= least) & (a != b) & (a.startswith(b) | b.startswith(a))

    first = lambda df, col: df.withColumn("b", F.substring(col, 1, least))
    parts = [
        first(c, "cm").join(first(t, "tm"), ["role", "b"]).where(close("cm", "tm") & close("cd", "td")),
        c.where("cm = ''").join(t.where("tm <> ''"), "role"),
        c.where("cd = ''").join(t.where("td <> ''"), "role"),
    ]
    out = None
    for part in parts:
        part = part.select("component_class", "target_class")
        out = part if out is None else out.unionAll(part)
    return out.distinct()


def kept(df: DataFrame, path: str) -> DataFrame:
    """df, written to path and read from there, for consumers that use it several times."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _same(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """An inner join in which null keys are equal, too."""
    met = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_same_{k}"))
    return left.join(met.hint("merge"), on).drop(*(f"_same_{k}" for k in keys))


def _dealt(members: DataFrame, keys: list[str], member: str, size: int) -> tuple[DataFrame, DataFrame]:
    """members with _block, an id's place among the blocks of its keys, and (keys, _block) of all blocks, so that no task has to take all members of one key."""
    blocks = members.groupBy(*keys).agg(F.ceil(F.count("*") / size).alias("_n"))
    dealt = members.join(blocks, keys).withColumn("_block", F.pmod(F.xxhash64(member), F.col("_n"))).drop("_n")
    return dealt, blocks.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("_block"))


@dataclass
class Applicability:
    """Links between classes, and the aircraft and directives that are in these."""

    links: DataFrame
    of_aircraft: DataFrame
    of_directives: DataFrame
    #: Makes the links from both members, where they come from these alone.
    how: Callable[[DataFrame, DataFrame], DataFrame] | None = None

    @classmethod
    def of(cls, components: DataFrame, targets: DataFrame, how=class_links) -> Applicability:
        a, d = component_members(components), target_members(targets)
        return cls(how(a, d), a, d, how)

    @classmethod
    def of_pairs(cls, pairs: DataFrame) -> Applicability:
        """From pairs of aircraft_id and directive_id, each a class of its own."""
        a, d = F.col("aircraft_id").cast("string").alias("component_class"), F.col("directive_id").cast("string").alias("target_class")
        return cls(pairs.select(a, d).distinct(), pairs.select("aircraft_id", a).distinct(), pairs.select("directive_id", d).distinct())

    def written(self, root: str) -> Applicability:
        """The same, kept as tables under root, for consumers that use it several times."""
        a, d = kept(self.of_aircraft, f"{root}/of_aircraft"), kept(self.of_directives, f"{root}/of_directives")
        return Applicability(kept(self.links if self.how is None else self.how(a, d), f"{root}/links"), a, d, self.how)

    def _profiles(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(aircraft_id, role, _a), (directive_id, _d) and (_a, _d, roles): members with all their classes that have a link as one profile, and linked profiles with the roles of their links.

        A directive whose links are all of one role meets the aircraft's classes of that
        role; one with links of several roles meets the aircraft's classes of all. So a pair
        belongs to just one pair of profiles, even where an id has several classes.
        """
        a, d = self.of_aircraft.select("aircraft_id", "role", "component_class"), self.of_directives.select("directive_id", "target_class")
        links = self.links.join(a.select("component_class", "role").distinct(), "component_class").distinct()
        profile = lambda part, c: F.concat(F.array(part), F.array_sort(F.collect_set(c)))
        d = d.join(links.select("target_class", F.col("role").alias("_r")).distinct(), "target_class").groupBy("directive_id")
        d = d.agg(profile(F.when(F.min("_r") == F.max("_r"), F.min("_r")).otherwise(""), "target_class").alias("_d"))
        of_d = d.select("_d").distinct().withColumns({"_part": F.get("_d", F.lit(0)), "target_class": F.explode(F.slice("_d", 2, F.size("_d")))})
        mixed = links.join(of_d.where("_part = ''").select("target_class").distinct(), "target_class", "left_semi").select("component_class").distinct()
        linked = a.join(links.select("component_class").distinct(), "component_class", "left_semi")
        one = linked.groupBy("aircraft_id", "role").agg(profile(F.col("role"), "component_class").alias("_a"))
        all_ = linked.join(mixed, "component_class", "left_semi").groupBy("aircraft_id").agg(profile(F.lit(""), "component_class").alias("_a"), F.collect_set("role").alias("role"))
        a = one.unionByName(all_.withColumn("role", F.explode("role")))
        of_a = a.select("_a").distinct().withColumns({"_part": F.get("_a", F.lit(0)), "component_class": F.explode(F.slice("_a", 2, F.size("_a")))})
        met = of_a.join(links, "component_class").join(of_d, ["_part", "target_class"]).groupBy("_a", "_d").agg(F.collect_set("role").alias("roles"))
        return a, d, met

    def pairs(self, first: bool = False, aircraft: DataFrame | None = None, directives: DataFrame | None = None, without: DataFrame | None = None) -> DataFrame:
        """(aircraft_id, directive_id, role): all pairs, each once; with first one row for each aircraft and directive, by the first role. Their number grows with the product of both sides; filter a side before.

        The columns of aircraft(aircraft_id, role, ...) and directives(directive_id, ...)
        come with the pairs, which are then repeated for each of their rows there; pairs of
        without(aircraft_id, directive_id) are left out. Pairs are made by the last join, of
        blocks of both sides, and are not shuffled: before it there is a row for each
        aircraft and block of directives, and for each directive and block of aircraft.
        """
        root = shared_folder(self.links.sparkSession, "pairs")
        a, d, met = self.written(root)._profiles()
        a, d = kept(a, f"{root}/aircraft"), kept(d, f"{root}/directives")
        met = met.withColumn("role", F.explode(F.array(F.array_min("roles")) if first else F.col("roles"))).drop("roles")
        a, a_blocks = _dealt(a, ["_a", "role"], "aircraft_id", AIRCRAFT_BLOCK)
        d, d_blocks = _dealt(d, ["_d"], "directive_id", DIRECTIVE_BLOCK)
        both = met.join(a_blocks.withColumnRenamed("_block", "_ab"), ["_a", "role"]).join(d_blocks.withColumnRenamed("_block", "_db"), "_d")
        both = both.withColumn("_both", F.unhex(F.md5(F.to_json(F.struct("_a", "_d", "role", "_ab", "_db")))))
        both = kept(both, f"{root}/blocks")
        a, d = a.withColumnRenamed("_block", "_ab"), d.withColumnRenamed("_block", "_db")
        left = a.join(both.select("_a", "role", "_ab", "_both").hint("merge"), ["_a", "role", "_ab"]).drop("_a", "_ab")
        right = d.join(both.select("_d", "_db", "_both").hint("merge"), ["_d", "_db"]).drop("_d", "_db")
        # By number, as few bytes make many pairs here and would be put together.
        n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        if aircraft is not None:
            left = _same(left, aircraft, "aircraft_id", "role")
        if directives is not None:
            right = _same(right, directives, "directive_id")
        left, right = left.repartition(n, "_both"), right.repartition(n, "_both")
        if without is not None:
            met = without.select("aircraft_id", "directive_id").join(a.hint("merge"), "aircraft_id").join(d.hint("merge"), "directive_id").join(both, ["_a", "role", "_ab", "_d", "_db"])
            known = met.groupBy("_both", "aircraft_id").agg(F.collect_set("directive_id").alias("_left_out"))
            left = left.join(known.repartition(n, "_both").hint("merge"), ["_both", "aircraft_id"], "left")
        out = left.join(right.hint("merge"), "_both").drop("_both")
        if without is not None:
            out = out.where("not coalesce(array_contains(_left_out, directive_id), false)").drop("_left_out")
        return out.select("aircraft_id", "directive_id", "role", *(c for c in out.columns if c not in ("aircraft_id", "directive_id", "role")))

    def among(self, rows: DataFrame) -> DataFrame:
        """Those of rows(aircraft_id, directive_id, ...) whose aircraft and directive are linked; grows with the rows."""
        # Members are far larger in memory than their files, so the driver must not take them for a small table.
        met = rows.join(self.of_aircraft.select("aircraft_id", "component_class").distinct().hint("merge"), "aircraft_id").join(self.of_directives.select("directive_id", "target_class").distinct().hint("merge"), "directive_id")
        return met.join(self.links, ["component_class", "target_class"], "left_semi").select(rows.columns).distinct()

    def first_roles(self, rows: DataFrame) -> DataFrame:
        """(aircraft_id, directive_id, role): those pairs of rows that are linked, each once, with the first role; grows with the rows."""
        links = self.links.join(self.of_aircraft.select("component_class", "role").distinct(), "component_class")
        met = _same(rows.select("aircraft_id", "directive_id").distinct(), self.of_aircraft.select("aircraft_id", "component_class").distinct(), "aircraft_id")
        met = _same(met, self.of_directives.select("directive_id", "target_class").distinct(), "directive_id").join(links, ["component_class", "target_class"])
        return met.groupBy("aircraft_id", "directive_id").agg(F.min("role").alias("role"))

    def of_only(self, directives: DataFrame) -> Applicability:
        """The same for the directives of directives(directive_id) alone."""
        d = self.of_directives.join(directives.select("directive_id").distinct(), "directive_id", "left_semi")
        return Applicability(self.links if self.how is None else self.how(self.of_aircraft, d), self.of_aircraft, d, self.how)

    def counts(self) -> DataFrame:
        """(component_class, target_class, aircraft, directives): each link with the members of its classes."""
        a = self.of_aircraft.groupBy("component_class").agg(F.countDistinct("aircraft_id").alias("aircraft"))
        d = self.of_directives.groupBy("target_class").agg(F.countDistinct("directive_id").alias("directives"))
        return self.links.join(a, "component_class").join(d, "target_class")

    def rows(self) -> DataFrame:
        """All pairs without a row for each: a row of kind link for each link, as counts() has it, and for each member of a linked class one of kind aircraft or directive.

        A pair is linked where a link joins a class of the aircraft to one of the directive. The rows grow with the members, not with their product.
        """
        a = self.of_aircraft.select("component_class", "aircraft_id").distinct().join(self.links, "component_class", "left_semi")
        d = self.of_directives.select("target_class", "directive_id").distinct().join(self.links, "target_class", "left_semi")
        out = self.counts().withColumn("kind", F.lit("link"))
        for name, members in (("aircraft", a), ("directive", d)):
            out = out.unionByName(members.withColumn("kind", F.lit(name)), allowMissingColumns=True)
        return out.select("kind", "component_class", "target_class", "aircraft_id", "directive_id", "aircraft", "directives")


#: An aircraft's facts that its products are compared with.
FACTS = ("make", "model", "engine_make", "engine_model", "propeller_make", "propeller_model")


def containing(texts: DataFrame, parts: DataFrame, width: int = 4) -> DataFrame:
    """(text, part) of distinct non-empty texts and the parts that they contain.

    A part's first `width` characters occur in every text that contains it, so the join is
    on runs of characters and only its hits are compared.
    """
    t, p = texts.select("text").where("text <> ''").distinct(), parts.select("part").where("part <> ''").distinct()
    of = lambda s, w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - w + 1, F.lit(1))), lambda k: s.substr(k, F.lit(w)))
    runs = F.array_distinct(F.flatten(F.array(*(of(F.col("text"), w) for w in range(1, width + 1)))))
    met = t.select("text", F.explode(runs).alias("_run")).join(p.select("part", F.substring("part", 1, width).alias("_run")), "_run")
    return met.where(F.col("text").contains(F.col("part"))).select("text", "part")


def product_classes(directives: DataFrame) -> DataFrame:
    """(directive_id, product_class): the directive's products, lower case, distinct, sorted; no products are a class, too."""
    low = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("products", F.array().cast("array<string>")), F.lower), lambda x: x.isNotNull() & (x != ""))))
    return directives.select("directive_id", low.alias("product_class"))


def fact_classes(aircraft: DataFrame) -> DataFrame:
    """(aircraft_id, fact_class): the aircraft's facts, lower case, distinct, sorted."""
    facts = F.array_compact(F.array(*(F.lower(optional_text(F.col(c))) if c in aircraft.columns else F.lit(None).cast("string") for c in FACTS)))
    return aircraft.select("aircraft_id", F.array_sort(F.array_distinct(facts)).alias("fact_class"))


def product_links(facts: DataFrame, products: DataFrame) -> DataFrame:
    """(fact_class, product_class) where a product stands in the class's joined facts or a fact stands in a product."""
    f = facts.select("fact_class").distinct().withColumn("joined", F.array_join("fact_class", " "))
    p = products.select("product_class").distinct().select("product_class", F.explode("product_class").alias("product"))
    in_facts = containing(f.select(F.col("joined").alias("text")), p.select(F.col("product").alias("part"))).select(F.col("text").alias("joined"), F.col("part").alias("product"))
    terms = f.select("fact_class", F.explode("fact_class").alias("term"))
    in_product = containing(p.select(F.col("product").alias("text")), terms.select(F.col("term").alias("part"))).select(F.col("text").alias("product"), F.col("part").alias("term"))
    hits = in_facts.join(f, "joined").select("fact_class", "product").unionAll(in_product.join(terms, "term").select("fact_class", "product")).distinct()
    return hits.join(p, "product").select("fact_class", "product_class").distinct()


def product_matches(pairs: DataFrame, aircraft: DataFrame, directives: DataFrame) -> DataFrame:
    """Those of pairs(aircraft_id, directive_id) whose products fit by their wording; a directive without products fits all aircraft."""
    facts, products = fact_classes(aircraft), product_classes(directives)
    met = pairs.select("aircraft_id", "directive_id").distinct().join(facts, "aircraft_id").join(products, "directive_id")
    linked = met.join(product_links(facts, products), ["fact_class", "product_class"], "left_semi")
    return linked.unionByName(met.where("size(product_class) = 0")).select("aircraft_id", "directive_id")

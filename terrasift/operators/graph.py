"""Connectivity of cells on the lattice, for all cities at once.

Loops run on the driver, but each round is a join over all cities; what they hold
is written to shared storage each round. A link's straight path is always taken
from the smaller to the larger cell, so links have no direction, and every choice
has a tie-break, so results do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hexgrid
from ..storage import keep

KEY = ["city", "cell"]


def interior(a: Column, b: Column) -> Column:
    """The cells between two cells, from the smaller to the larger id."""
    whole = hexgrid.path(F.least(a, b), F.greatest(a, b))
    return F.element_at(F.transform(F.array(whole), lambda w: F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0)))), 1)


def links(allowed: DataFrame, bridge: int = 1, land: DataFrame | None = None) -> DataFrame:
    """(city, cell, other): pairs of allowed cells that a step joins: neighbours, and
    cells up to bridge steps apart whose path crosses no land."""
    far = allowed.select("city", "cell", F.explode(hexgrid.disk(F.col("cell"), bridge)).alias("other")).where("cell < other")
    met = far.join(allowed.select("city", F.col("cell").alias("other")), ["city", "other"], "left_semi").select("city", "cell", "other")
    d = hexgrid.steps(F.col("cell"), F.col("other"))
    short = met.where(d <= 1)
    if bridge <= 1:
        return short
    crossing = met.where(d > 1).withColumn("between", F.explode(interior(F.col("cell"), F.col("other"))))
    ground = (allowed if land is None else land).select("city", F.col("cell").alias("between"))
    blocked = crossing.join(ground, ["city", "between"], "left_semi").select("city", "cell", "other").distinct()
    return short.union(met.where(d > 1).join(blocked, ["city", "cell", "other"], "left_anti"))


def components(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """(city, cell, component) of all cells: the smallest cell that links reach. Each round
    takes the smallest label of the neighbours, then that label's own."""
    both = keep(edges.select("city", "cell", "other").union(edges.select("city", F.col("other"), F.col("cell"))).distinct())
    labels = keep(cells.select(*KEY, F.col("cell").alias("component")).distinct())
    while True:
        near = both.join(labels.select("city", F.col("cell").alias("other"), "component"), ["city", "other"]).groupBy(*KEY).agg(F.min("component").alias("near"))
        step = labels.join(near, KEY, "left").select(*KEY, F.col("component").alias("old"), F.least("component", "near").alias("step"))
        jump = labels.select("city", F.col("cell").alias("step"), F.col("component").alias("far"))
        new = keep(step.join(jump, ["city", "step"]).select("city", "cell", "old", F.least("step", "far").alias("component")))
        labels = new.select("city", "cell", "component")
        if new.where("old <> component").isEmpty():
            return labels


def clusters(cells: DataFrame) -> DataFrame:
    """Components of neighbouring cells."""
    cells = keep(cells.select(*KEY))
    return components(cells, links(cells, 1))


def connected(seeds: DataFrame, allowed: DataFrame, bridge: int = 1, land: DataFrame | None = None) -> DataFrame:
    """(city, cell): what each city's seed reaches; nothing where it is not allowed."""
    allowed = keep(allowed.select(*KEY))
    found = components(allowed, links(allowed, bridge, land))
    own = found.join(seeds.select(*KEY), KEY, "left_semi").select("city", "component").distinct()
    return found.join(own, ["city", "component"], "left_semi").select(*KEY)


def supported_paths(outside: DataFrame, inside: DataFrame, cells: DataFrame, urban: DataFrame, max_gap: int, min_road: float, min_access: float) -> DataFrame:
    """(city, component, a, b, between): for each component of outside its shortest path to
    inside over 1 to max_gap cells of land that is not urban but has roads and
    access; ties go to the smaller a, then b."""
    reach = outside.select("city", "component", F.col("cell").alias("a"), F.explode(hexgrid.disk(F.col("cell"), max_gap + 1)).alias("b"))
    met = reach.join(inside.select("city", F.col("cell").alias("b")), ["city", "b"], "left_semi")
    met = met.withColumn("steps", hexgrid.steps(F.col("a"), F.col("b"))).where(F.col("steps").between(2, max_gap + 1)).withColumn("between", interior(F.col("a"), F.col("b")))
    good = cells.where((F.col("road_density_km") >= min_road) & (F.col("establishment_access") >= min_access)).select(*KEY).join(urban.select(*KEY), KEY, "left_anti")
    each = met.select("city", "component", "a", "b", "steps", "between", F.explode("between").alias("cell")).join(good.withColumn("ok", F.lit(True)), KEY, "left")
    whole = each.groupBy("city", "component", "a", "b", "steps", "between").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok")).where("ok")
    first = Window.partitionBy("city", "component").orderBy("steps", "a", "b")
    return whole.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "ok", "steps")


def connectors(cells: DataFrame, urban: DataFrame, metro: DataFrame, max_gap: int = 2, min_component: int = 12, min_road: float = 2.0, min_access: float = 3.0) -> DataFrame:
    """(city, cell): gap cells that attach urban clusters of at least min_component cells to
    the metro. Every round attaches all clusters that have a path, until none has."""
    gaps = urban.select(*KEY).limit(0)
    inside = keep(metro.select(*KEY))
    while max_gap > 0:
        outside = urban.select(*KEY).join(inside, KEY, "left_anti")
        found = clusters(outside)
        large = found.groupBy("city", "component").count().where(F.col("count") >= min_component)
        found = found.join(large, ["city", "component"], "left_semi")
        paths = keep(supported_paths(found, inside, cells, urban, max_gap, min_road, min_access))
        if paths.isEmpty():
            break
        new = paths.select("city", F.explode("between").alias("cell")).distinct()
        joined = found.join(paths, ["city", "component"], "left_semi").select(*KEY)
        gaps = keep(gaps.union(new).distinct())
        inside = keep(inside.union(new).union(joined).distinct())
    return gaps


def urban(cells: DataFrame, min_poi: float = 3.0, min_road: float = 4.0, min_access: float = 3.0) -> Column:
    """Enough establishments, or enough road and (if min_access is positive) access."""
    road = F.col("road_density_km") >= min_road
    road = road & (F.col("establishment_access") >= min_access) if min_access > 0 else road
    return F.coalesce((F.col("poi_count") >= min_poi) | road, F.lit(False))


def delineate(cells: DataFrame, downtowns: DataFrame, metro: dict) -> DataFrame:
    """cells with is_urban, is_connector and in_metro. The seed of a city is its downtown's
    cell, or else the urban cell nearest to downtown. cells: city, cell, dist_cbd_km,
    poi_count, road_density_km, establishment_access; downtowns: city, cell."""
    # Each round of connectors reads the cells again.
    marked = keep(cells.withColumn("is_urban", urban(cells, metro["min_poi_per_cell"], metro["min_road_km_per_cell"], metro["min_establishment_access_for_road_cell"])))
    town = keep(marked.where("is_urban").select(*KEY, "dist_cbd_km"))
    centre = downtowns.select("city", F.col("cell").alias("centre"))
    seeds = town.join(centre, "city", "left").groupBy("city").agg(F.min(F.struct((F.col("cell") != F.col("centre")).alias("other"), "dist_cbd_km", "cell")).alias("s")).select("city", F.col("s.cell").alias("cell"))
    seeds = keep(seeds)
    land = marked.select(*KEY)
    core = connected(seeds, town, metro["bridge_gap"], land)
    gaps = connectors(marked, town, core, metro["connector_gap"], metro["connector_min_component_cells"], metro["connector_min_road_km_per_cell"], metro["connector_min_establishment_access"])
    if not gaps.isEmpty():
        core = connected(seeds, town.select(*KEY).union(gaps).distinct(), metro["bridge_gap"], land)
    flag = lambda df, name: df.select(*KEY, F.lit(True).alias(name))
    out = marked.join(flag(gaps, "is_connector"), KEY, "left").join(flag(core, "in_metro"), KEY, "left")
    return out.fillna(False, ["is_connector", "in_metro"])

"""Chart suggestions for every table of a catalog, best six per table.

Works on one row per table, so suggesting charts for a whole lake is a map over
tables after one grouping of the columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CHARTS = 6
SUITABLE = 50
UNLISTED_SCORE = 20

# Column names that read as places, dates and labels.
GEO_NAMES = (r"(?i)^(lat|lng|latitude|longitude|country|region|city|state|zip|zipcode|geoid)$")
DATE_NAMES = (r"(?i)^(date|day|month|year|week|quarter|period|time|timestamp|created_at"
              r"|updated_at)$")
LABEL_NAMES = (r"(?i)^(name|label|category|type|status|segment|group|tag|product|channel|source"
               r"|region|country|city)$")



# Chart, score, condition on column counts. ``num``, ``cat``,
# ``time`` and ``geo`` count a table's columns by kind; earlier rows win ties.
CHART_RULES = [
    ("table", "40", "total > 0"),
    ("line", "92", "time >= 1 and num >= 1"),
    ("area", "80", "time >= 1 and num >= 1"),
    ("area_stacked", "74", "time >= 1 and num >= 2"),
    ("bar", "if(time = 0, 90, 72)", "cat >= 1 and num >= 1"),
    ("bar_horizontal", "if(time = 0, 78, 60)", "cat >= 1 and num >= 1"),
    ("pie", "68", "num = 1 and cat = 1"),
    ("donut", "65", "num = 1 and cat = 1"),
    ("funnel", "60", "num = 1 and cat = 1"),
    ("bar_stacked", "75", "num >= 2 and cat >= 1"),
    ("radar", "62", "num >= 3 and cat >= 1"),
    ("scatter", "if(cat = 0 and time = 0, 85, 58)", "num >= 2"),
    ("bubble", "70", "num >= 3"),
    ("kpi_card", "95", "num = 1 and cat = 0 and time = 0"),
    ("number_card", "88", "num = 1 and cat = 0 and time = 0"),
    ("gauge", "72", "num = 1 and cat = 0 and time = 0"),
    ("geo_map", "if(geo >= 2, 88, 75)", "geo >= 1"),
    ("treemap", "70", "cat >= 2 and num >= 1"),
    ("sunburst", "60", "cat >= 2 and num >= 1"),
    ("heatmap", "65", "cat >= 2 and num >= 1"),
    ("waterfall", "58", "(time >= 1 or cat >= 1) and num = 1"),
    ("sankey", "62", "cat >= 2 and num >= 1"),
]

# Which column goes on which axis, where it differs from (category, first number).
X_AXIS = {
    "line": "time_field", "area": "time_field", "area_stacked": "time_field",
    "scatter": "num_1", "bubble": "num_1", "geo_map": "geo_x",
    "waterfall": "coalesce(time_field, cat_field)", "sankey": "cat_1",
    "table": "null", "kpi_card": "null", "number_card": "null", "gauge": "null",
}
Y_AXIS = {"scatter": "num_2", "bubble": "num_2", "geo_map": "geo_y", "heatmap": "cat_2",
          "sankey": "cat_2", "table": "null"}


# Which column gives colour and size, where one does.
COLOUR = {"line": "cat_field", "bar_stacked": "cat_field",
          "scatter": "cat_field", "bubble": "cat_field",
          "geo_map": "if(geo >= 2, num_1, null)", "heatmap": "num_1", "sankey": "num_1"}
SIZE = {"bubble": "num_3"}

# Why a chart is suggested, by the columns it needs.
REASON = {
    "table": "any columns can be listed",
    "line": "a number over time", "area": "a number over time, as a filled band",
    "area_stacked": "several numbers over time, stacked",
    "bar": "a number compared across categories",
    "bar_horizontal": "a number compared across categories with long names",
    "pie": "parts of one whole, few slices", "donut": "parts of one whole, few slices",
    "funnel": "a number over ordered stages",
    "bar_stacked": "several numbers per category", "radar": "a profile of several numbers",
    "scatter": "two numbers against each other",
    "bubble": "three numbers: two axes and size",
    "kpi_card": "a single number", "number_card": "a single number",
    "gauge": "a single number against a goal", "geo_map": "places with a number",
    "treemap": "nested categories by size", "sunburst": "nested categories in rings",
    "heatmap": "a number over two categories", "waterfall": "steps that add up to a number",
    "sankey": "flows between two categories",
}


def column_kind(name: Column, declared: Column) -> Column:
    return (F.when(declared == "number", F.lit("num"))
            .when(declared == "timestamp", F.lit("time"))
            .when(name.rlike(GEO_NAMES), F.lit("geo"))
            .when(declared.isin("boolean", "string"), F.lit("cat"))
            .otherwise(F.lit("other")))


def chart_facts(columns: DataFrame) -> DataFrame:
    """Per table: columns by kind and the ones that suit an axis best."""
    kinds = columns.select("table_name", "ordinal_position", "column_name",
                           column_kind(F.col("column_name"), F.col("declared_type")).alias("k"))
    # one entry per column of a table: the list is as long as its schema
    listed = kinds.groupBy("table_name").agg(
        F.sort_array(F.collect_list(F.struct("ordinal_position", "column_name", "k"))).alias("c"),
        F.count(F.lit(1)).alias("total"))

    def names(kind):
        return F.transform(F.filter("c", lambda c: c["k"] == kind), lambda c: c["column_name"])

    out = listed.select("table_name", "total", *[names(k).alias(f"l_{k}")
                                                 for k in ("num", "cat", "time", "geo")])

    def preferred(listing, pattern):
        return F.coalesce(F.get(F.filter(listing, lambda n: n.rlike(pattern)), F.lit(0)),
                          F.get(listing, F.lit(0)))

    geo = F.col("l_geo")
    lat = F.get(F.filter(geo, lambda n: n.rlike("(?i)lat")), F.lit(0))
    lng = F.get(F.filter(geo, lambda n: n.rlike("(?i)lng|lon")), F.lit(0))
    pair = F.size(geo) >= 2
    num_1 = F.get("l_num", F.lit(0))
    return out.select(
        "table_name", "total",
        *[F.size(f"l_{k}").alias(k) for k in ("num", "cat", "time", "geo")],
        *[F.get("l_num", F.lit(i)).alias(f"num_{i + 1}") for i in range(3)],
        *[F.get("l_cat", F.lit(i)).alias(f"cat_{i + 1}") for i in range(2)],
        preferred(F.col("l_cat"), LABEL_NAMES).alias("cat_field"),
        preferred(F.col("l_time"), DATE_NAMES).alias("time_field"),
        F.when(pair, lng).otherwise(F.get(geo, F.lit(0))).alias("geo_x"),
        F.when(pair, lat).otherwise(num_1).alias("geo_y"))


def chart_suggestions(columns: DataFrame, n: int = MAX_CHARTS) -> DataFrame:
    """Best charts per table with score, axes, colour, size and reason.

    ``columns`` holds ``table_name, column_name, declared_type, ordinal_position``.
    """
    rules = [
        F.when(F.expr(cond), F.struct(
            (-F.expr(score)).alias("order"), F.lit(i).alias("position"),
            F.lit(chart).alias("chart"), F.expr(score).alias("score"),
            F.expr(X_AXIS.get(chart, "cat_field")).cast("string").alias("x_field"),
            F.expr(Y_AXIS.get(chart, "num_1")).cast("string").alias("y_field"),
            F.expr(COLOUR.get(chart, "null")).cast("string").alias("color_field"),
            F.expr(SIZE.get(chart, "null")).cast("string").alias("size_field"),
            F.lit(REASON[chart]).alias("reason")))
        for i, (chart, score, cond) in enumerate(CHART_RULES)]
    best = F.slice(F.sort_array(F.filter(F.array(*rules), lambda r: r.isNotNull())), 1, n)
    return (chart_facts(columns).select("table_name", F.posexplode(best).alias("p", "r"))
            .select("table_name", (F.col("p") + 1).alias("position"), "r.chart", "r.score",
                    "r.x_field", "r.y_field", "r.color_field", "r.size_field", "r.reason"))


def chart_fit(columns: DataFrame, chart: str) -> DataFrame:
    """Score of one chart per table; charts not among the best six get a low score."""
    best = chart_suggestions(columns).where(F.col("chart") == chart).select("table_name", "score")
    tables = columns.select("table_name").distinct()
    score = F.coalesce(F.col("score"), F.lit(UNLISTED_SCORE))
    return tables.join(best, "table_name", "left").select(
        "table_name", score.alias("score"), (score >= SUITABLE).alias("suitable"))

"""Plan properties that must hold at any scale."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from httploom.operators import dedup, filters, findings, journeys, mapping, parameters, surface, variants, vectors
from workload import catalogue
from workload import fixtures as fx

SF_DIR = "/root/testdata/sf0.001"
# Recursion runs its own small plans; a scalar subquery of one row shows up as itself.
SINGLE_ROW = {"s07_coverage"}


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_no_cross_or_nested_loop_join(spark, name):
    text = plan(catalogue.QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_reach_the_scan(spark):
    items = fx.te_items(spark, SF_DIR)
    text = plan(filters.by_status(filters.by_tools(items, "proxy,repeater"), "401,5xx").select("index"))
    assert "In(tool, [proxy,repeater])" in text and "StringStartsWith(status,5)" in text and "In(status, [401,5xx])" in text
    assert "GreaterThanOrEqual(time" in plan(filters.by_time(items, "2024-01-02", "2024-01-03"))


@pytest.mark.parametrize(
    "build, columns",
    [
        (lambda i: findings.row_findings(i, findings.unauthenticated_rule()), {"index", "host", "method", "path", "status", "request_headers", "slug"}),
        (findings.state_changing_methods, {"index", "host", "path", "method"}),
        (surface.top_endpoints, {"index", "method", "protocol", "host", "port", "path"}),
        (lambda i: filters.by_tools(i, "proxy").select("index"), {"index", "tool"}),
    ],
)
def test_scans_read_only_what_they_need(spark, build, columns):
    text = plan(build(fx.te_items(spark, SF_DIR)))
    schemas = {line for line in text.splitlines() if line.startswith("ReadSchema")}
    read = set()
    for line in schemas:
        depth, name = 0, ""
        for char in line.split("struct<", 1)[1]:
            if char == "<":
                depth += 1
            elif char == ">":
                depth -= 1
            elif depth == 0 and char == ":":
                read.add(name)
            name = "" if char in ",<>" else name + char
    assert read - {"name", "value"} <= columns


def test_row_rules_share_one_scan_without_shuffle(spark):
    text = plan(findings.row_findings(fx.te_items(spark, SF_DIR), *[rule() for rule in findings.ROW_RULES.values()]))
    assert "Exchange" not in text and text.count("Scan parquet") == 2  # tree line and detail line


def test_first_rows_per_group_are_cut_before_the_shuffle(spark):
    items = fx.te_items(spark, SF_DIR)
    for df in (mapping.samples(items), parameters.examples(parameters.parameters(items))):
        assert "WindowGroupLimit" in plan(df)


def test_no_window_carries_bodies(spark):
    items = fx.te_items(spark, SF_DIR)
    for df in (dedup.reindex(items), dedup.union_captures(items, items)):
        for node in plan(df).split("\n\n"):
            if "Window" in node.split("\n")[0]:
                assert "request_raw" not in node and "response_body" not in node


def test_top_k_is_not_a_full_sort(spark):
    items = fx.te_items(spark, SF_DIR)
    index = fx.table(spark, SF_DIR, "embeddings").withColumnRenamed("vec_id", "id")
    nearest = vectors.nearest(index, F.array(*[F.lit(0.1)] * 64), 5)
    for df in (surface.top_endpoints(items), nearest):
        assert "TakeOrderedAndProject" in plan(df)
    assert "Exchange" not in plan(nearest)


def test_aggregates_combine_before_the_shuffle(spark):
    items = fx.te_items(spark, SF_DIR)
    for df in (dedup.endpoint_changes(items, items), findings.missing_security_headers(items)):
        text = plan(df)
        assert "partial_bit_or" in text or "partial_bool_or" in text or "partial_max" in text


def test_building_items_deals_narrow_rows(spark):
    dealt = [node for node in plan(fx.build_te_items(spark, SF_DIR)).split("\n\n") if "Exchange" in node.split("\n")[0]]
    assert dealt and all("props" in node and "request_raw" not in node for node in dealt)


def test_parameter_rows_are_not_sorted_to_be_grouped(spark):
    rows = parameters.parameters(fx.te_items(spark, SF_DIR))
    assert "SortAggregate" not in plan(parameters.examples(rows))
    for node in plan(parameters.index(rows)).split("\n\n"):
        assert "SortAggregate" not in node.split("\n")[0] or "count(1)" not in node


def test_first_spelling_of_a_parameter_is_that_of_the_first_place(spark):
    columns = "source string, key string, name string, value string, endpoint string, host string, index long, pos int"
    row = lambda name, index, pos, endpoint: ("query", "id", name, f"{name}{pos}", endpoint, "h", index, pos)
    big = (1 << 62) + 1
    rows = spark.createDataFrame([row("id", big, 3, "a"), row("ID", big, 2, "b"), row("Id", big, 2**31 - 1, "a")], columns)
    found = parameters.index(rows).first()
    assert (found["name"], found["occurrences"], found["endpoint_count"], found["host_count"]) == ("ID", 3, 2, 1)
    assert found["example_values"] == ["ID2", "id3", f"Id{2**31 - 1}"]


def test_manifest_reads_findings_that_are_made_once(spark):
    items = fx.te_items(spark, SF_DIR)
    found = findings.row_findings(items, findings.id_rule()).withColumn("finding_id", F.col("ord"))
    assert "Potential IDOR" not in plan(variants.manifest(found, items))


@pytest.mark.parametrize(
    "url, point, expected",
    [
        ("https://a/x/1/y?q=%20z#f", ("path_segment", "path[2]", "1", 2), "https://a/x/V &/y?q=%20z#f"),
        ("https://a/1", ("path_segment", "path[1]", "1", 1), "https://a/V &"),
        ("https://a/x", ("path_segment", "path[7]", "1", 7), "https://a/x"),
        ("https://a/p?a=1&b=2&b=3&c=%2B+#f", ("query_param", "b", "2", 0), "https://a/p?a=1&b=V+%26&b=3&c=%2B+#f"),
        ("https://a/p?b=2", ("query_param", "b", "2", 0), "https://a/p?b=V+%26"),
        ("https://a/p?a=1", ("query_param", "n", "", 0), "https://a/p?a=1&n=V+%26"),
        ("https://a/p", ("query_param", "n", "", 0), "https://a/p?n=V+%26"),
        ("https://a/p?a=1#f", ("json_body", "id", "1", 0), "https://a/p?a=1#f"),
    ],
)
def test_value_is_put_between_the_pieces_of_a_url(spark, url, point, expected):
    row = spark.createDataFrame([(url, point)], f"url string, point {variants.POINT}")
    pieces = variants.url_pieces(F.col("url"), F.col("point"))
    assert row.select(pieces.alias("p")).select(variants.joined_url(F.col("p"), F.lit("V &"))).first()[0] == expected
    assert row.select(variants.substituted_url(F.col("url"), F.col("point"), F.lit("V &"))).first()[0] == expected


def test_sorting_findings_does_not_make_them_twice(spark):
    text = plan(findings.sort_findings(findings.all_findings(fx.te_items(spark, SF_DIR))))
    assert "Generate" not in text and text.count("Scan parquet") == 2  # tree line and detail line


def test_samples_read_items_once(spark):
    text = plan(mapping.samples(fx.te_items(spark, SF_DIR)))
    assert "request_headers" not in text and "session_tag" not in text


def test_only_the_items_of_samples_are_masked(spark):
    tree = plan(mapping.sample_records(fx.te_items(spark, SF_DIR))).split("\n\n")[0].splitlines()
    python = [n for n, line in enumerate(tree) if "ArrowEvalPython" in line]
    joins = [n for n, line in enumerate(tree) if "Join" in line]
    assert python and joins and max(python) < min(joins)


def test_fields_are_masked_without_lambdas_over_rows(spark):
    """Lambdas are interpreted; over every field of every item they took most of the time."""
    text = plan(dedup.redact_items(fx.te_items(spark, SF_DIR)))
    tree = text.split("\n\n")[0]
    assert tree.count("ArrowEvalPython") == 1 and "lambda" not in text


def test_vector_documents_mask_what_they_show(spark):
    text = plan(vectors.documents(fx.te_items(spark, SF_DIR)))
    read = next(line for line in text.splitlines() if line.startswith("ReadSchema"))
    assert "request_body" in read and "request_raw" not in read and "response_headers" not in read


def test_id_flow_reads_request_headers_once_for_each_side(spark):
    text = plan(journeys.id_flow(fx.te_items(spark, SF_DIR), hot_rows=200))
    assert sum("request_headers" in line for line in text.splitlines() if line.startswith("ReadSchema")) == 1


def test_endpoints_are_read_from_a_stored_table(spark):
    assert "request_headers" not in plan(mapping.endpoints(fx.te_items(spark, SF_DIR)))

"""What plans do once, and over how many tasks: work that was repeated, or stayed in the task of a small file."""

import pytest

from lectern.plans import registry


def plan(spark, sf, name):
    return registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["t_03_page_quality", "t_04_quality_failures", "t_06_ocr_merge"])
def test_page_quality_counts(spark, sf, name):
    """Rows are dealt out, characters are counted by dropping the others' runs, tokens without looking behind each character."""
    p = plan(spark, sf, name)
    assert "Repartition" in p and r"\p{IsCyrillic}, 0" not in p and "(?<!" not in p


def test_boxes_are_made_once(spark, sf):
    p = plan(spark, sf, "t_08_chunk_boxes")
    assert "Repartition" in p and not any("Filter" in line and "xMin" in line for line in p.splitlines())


def test_shapes_are_parsed_once(spark, sf):
    p = plan(spark, sf, "v_05_stat_block_shapes")
    # seven parts, a parse each; a plan names a parse's text once
    assert "Repartition" in p and p.count("parse_json") <= 7


@pytest.mark.parametrize("name", ["cdc_05_index_chunks", "cdc_05_index_entries"])
def test_revisions_are_swept_once(spark, sf, name):
    """What was judged is read again, so that no later step sweeps."""
    assert "aggregate(" not in plan(spark, sf, name)


@pytest.mark.parametrize("name", ["g_07_cited_support", "g_07_supported_claims"])
def test_forms_are_made_once(spark, sf, name):
    """Segments are cut for forms that are kept."""
    assert ".{400,800}" not in plan(spark, sf, name)


def test_claims_are_formed_once(spark, sf):
    """Claims are cut without a regex that looks from each character for the line's end, formed once, and no tokens of chunks are shuffled."""
    p = plan(spark, sf, "g_07_cited_support")
    assert "regexp_extract" not in p and "LogicalRDD" in p and p.count("Generate explode") <= 2

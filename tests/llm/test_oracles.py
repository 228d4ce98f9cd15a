"""What SQL can state of queries whose whole result it cannot: the columns before the fitted part."""

import zlib

import duckdb
import pytest

from strandline.llm import queries
from tests.conftest import SF


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF.replace('0.001', '0.01')}/{name}.parquet'")
    return lambda text: sorted(map(str, con.execute(text).fetchall()))


def rows(frame, *columns):
    return sorted(str(tuple(r)) for r in frame.select(*columns).collect())


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def test_rule_counts(spark, sql):
    got = queries.op5_rules(spark, SF.replace("0.001", "0.01")).cache()
    want = sql(
        f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
        g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT *, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM w)),
        twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice CROSS JOIN (VALUES (0), (1), (2)) u(k) GROUP BY 1),
        lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w), dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1)
        SELECT doc_id, len(words)::BIGINT, coalesce(list_sum(list_transform(words, lambda x: length(x)))::BIGINT, 0), len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT, coalesce(dup.n, 0), coalesce(rep.n, 0),
        len(words) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(words) FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)"""
    )
    assert rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert got.where("base_failed AND kept").count() == 0


def test_hosts_and_explicit_rules(spark, sql):
    want = sql(
        r"""WITH u AS (SELECT page_id, lower(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')) AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(h, p, says)),
        m AS (SELECT page_id, h || p AS rule, says FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) = 1)
        SELECT page_id, host, path, rule, says FROM u LEFT JOIN m USING (page_id)"""
    )
    got = queries.op6_urls(spark, SF.replace("0.001", "0.01"))
    assert rows(got.selectExpr("page_id", "host", "path", "rule", "if(rule is null, null, verdict) as says"), "page_id", "host", "path", "rule", "says") == want


def test_sizes_and_targets(spark, sql):
    got = queries.op4_mixing(spark, SF.replace("0.001", "0.01")).cache()
    assert rows(got, "doc_id", "size", "source_size") == sql(
        f"WITH w AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents) SELECT doc_id, size, sum(size) OVER (PARTITION BY source)::BIGINT FROM w"
    )
    # the level of the targets by bisection: each is the least of twice the source and level times weight
    sums = {r.source: (r.size, r.target) for r in got.join(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet"), "doc_id").groupBy("source").agg({"source_size": "max", "target": "max"}).toDF("source", "size", "target").collect()}
    weight = dict(zip(sorted(sums, key=lambda s: (s is None, s)), [5.0, 2.0, 1.0] * len(sums)))
    low, high = 0.0, 10.0 * sum(s for s, _ in sums.values())
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * s, level * weight[n]) for n, (s, _) in sums.items()) < 1.5 * sum(s for s, _ in sums.values()) else (low, level)
    assert all(abs(t - min(2 * s, low * weight[n])) < 1e-6 * t + 1e-6 for n, (s, t) in sums.items())


@pytest.mark.parametrize("query", ["op9_quality", "op10_language"])
def test_held_out(spark, query):
    got = queries.QUERIES[query](spark, SF).select("doc_id", "held_out").collect()
    assert got and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)

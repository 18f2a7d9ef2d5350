"""The manifest against a tree built by hand, and against its SQL."""

from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from inkspark.llm import merkle
from inkspark.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, at):
    found = []
    for nodes in tree[:-1]:
        first = at - at % 3
        found.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 3])))
        at //= 3
    return found


@pytest.mark.parametrize("size", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 80, 81, 82, 243, 500, 728, 729])
def test_paths_of_a_block(size):
    leaves = [h(str(i)) for i in range(size)]
    tree = levels(leaves)
    deep = merkle.depth(True, size)
    assert deep == len(tree) - 1
    assert merkle.top(leaves, deep) == tree[-1][0]
    assert list(merkle.paths(leaves, deep)) == [siblings(tree, i) for i in range(size)]


@pytest.mark.parametrize("size", [1, 5, 700])
def test_last_block_of_a_longer_tree(size):
    """All levels, with parents of single nodes."""
    leaves, deep = [h(str(i)) for i in range(size)], merkle.depth(False, size)
    tree = [leaves]
    for _ in range(deep):
        tree.append([h(*tree[-1][i : i + 3]) for i in range(0, len(tree[-1]), 3)])
    assert deep == 6 and merkle.top(leaves, deep) == tree[-1][0]
    assert list(merkle.paths(leaves, deep)) == [siblings(tree, i) for i in range(size)]


def test_traversal_holds_few_nodes():
    """Two subtrees a tier, each of at most 3 + 9 nodes, whatever the block holds."""
    leaves = [h(str(i)) for i in range(729)]
    for low in (0, 2, 4):
        assert len(merkle.Subtree(leaves, low, low + 2, 0).whole().nodes) == 12


def awkward(spark):
    rows = [(i, f"text {i}\nline {i}", "en", "hot", 9) for i in range(2300)]
    rows += [(i, f"few {i}\n", "de", f"s{i % 7}", None) for i in range(3000, 3040)]
    rows += [(None, "no id\n", "en", "hot", 1), (None, None, None, None, None), (5000, "", "", "", 0), (5001, None, None, None, None), (5002, "a\n\nb", None, "é", -5)]
    rows += [(5003, "twice\n", "en", "hot", 5)] * 3 + [(5003, "other", "en", "hot", 5), (5004, "long\n" * 50_000, "en", "only", 1), (5005, "alone", "en", "z", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def result(docs):
    out = merkle.manifest(docs, claimed=merkle.without_breaks(2))
    rows = out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")
    return sorted(map(tuple, rows.collect()), key=str)


def by_sql(spark, docs):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    return sorted(con.execute(merkle.ORACLE_SQL).fetchall(), key=str)


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = result(docs)
    assert got == by_sql(spark, docs)
    found = {r[0]: r[-1] for r in got}
    assert len({r[3] for r in got}) == 1 and not all(found.values()) and any(found.values())


def test_other_columns_and_order_do_not_matter(spark):
    docs = awkward(spark).where("doc_id < 3100")
    more = docs.withColumns({c: F.lit("clash") for c in ("key", "pos", "digest", "path", "root", "subroot", "block", "claim")})
    assert result(docs) == result(more.orderBy("text"))


def test_empty(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA), claimed=merkle.without_breaks()).count() == 0


def test_one_row(spark):
    got = merkle.manifest(spark.createDataFrame([(1, "x", None, "s", 1)], SCHEMA)).collect()
    assert len(got) == 1 and got[0].leaf == got[0].subroot == got[0].root == h("1:11:s-1:11:x") and got[0].path == []


def test_proofs_hold_for_untouched_rows_only(spark):
    out = merkle.manifest(awkward(spark), claimed=F.concat("text", F.lit("!")))
    assert out.where("verified").where("doc_id < 5000").count() == 0
    same = merkle.manifest(awkward(spark), claimed=F.col("text"))
    assert same.where("not verified").count() == 0


def test_query(spark):
    out = QUERIES["op12_fractal_manifest"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(map(tuple, out.collect()), key=str) == by_sql(spark, docs)

import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A documents frame from (doc_id, text) pairs, in several partitions."""

    def make(rows, parts=3):
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows],
                                   "doc_id bigint, text string, lang string, source string, n_chars bigint")
        return df.repartition(parts)

    return make


@pytest.fixture(scope="session")
def matches_sql(spark):
    """Compare a registered query with its SQL over one folder of tables."""

    def check(name, sf="/root/testdata/sf0.001"):
        from daypanel.llm.queries import LLM_ORACLE, LLM_QUERIES
        from workload.compare import connect

        got = LLM_QUERIES[name](spark, sf)
        cols = sorted(got.columns)
        key = lambda r: [(v is None, str(v)) for v in r]
        ours = sorted((tuple(r) for r in got.select(*cols).collect()), key=key)
        listed = ", ".join(f'"{c}"' for c in cols)
        theirs = sorted(connect(sf).execute(f"SELECT {listed} FROM ({LLM_ORACLE[name]})").fetchall(), key=key)
        assert ours == theirs

    return check

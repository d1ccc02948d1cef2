import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.conftest import SF_SMALL

LONG = "run " * 30_000 + "x" * 5_000 + " end."
EDGE = [
    (900_001, None, "en", "src0", None), (900_002, "", "en", None, 0), (900_003, " \n\t ", None, "src1", 4),
    (900_004, LONG, "en", "src1", len(LONG)), (None, "A row without an id, twice.", "en", "src2", 27),
    (900_005, "Same text.", "en", "src3", 10), (900_005, "Same text.", "en", "src3", 10), (900_006, "Same text.", "fr", "src4", 10),
    (900_007, "你好，世界 👍🏽 ǅ İstanbul Σίσυφος ΣΑΣ <|endoftext|> don't'LL x\x1cy\x85z  \r\n\r\n  ok  ", "zh", "src5", 50),
]
SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])


@pytest.fixture(scope="session")
def edge_dir(tmp_path_factory):
    """The smallest documents with rows of every awkward kind added, beside the other text tables."""
    d = tmp_path_factory.mktemp("edge")
    docs = pq.read_table(f"{SF_SMALL}/documents.parquet").cast(SCHEMA)
    extra = pa.table([pa.array(c, t) for c, t in zip(zip(*EDGE), SCHEMA.types)], schema=SCHEMA)
    pq.write_table(pa.concat_tables([docs, extra]), d / "documents.parquet")
    for t in ("labels", "benchmark", "embeddings"):
        pq.write_table(pq.read_table(f"{SF_SMALL}/{t}.parquet"), d / f"{t}.parquet")
    return str(d)


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    pq.write_table(SCHEMA.empty_table(), d / "documents.parquet")
    for t in ("labels", "benchmark", "embeddings"):
        pq.write_table(pq.read_table(f"{SF_SMALL}/{t}.parquet").slice(0, 0), d / f"{t}.parquet")
    return str(d)


@pytest.fixture(scope="session")
def edge_docs(edge_dir):
    return duckdb.sql(f"SELECT * FROM '{edge_dir}/documents.parquet'").fetchall()

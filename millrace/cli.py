"""python -m millrace.cli ingest | index | ask | serve"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import index
from millrace.plans.ask import Engine
from millrace.plans.ingest import ingest
from millrace.service import serve
from millrace.sources import records


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace")
    kinds = parser.add_subparsers(dest="what", required=True)
    a = kinds.add_parser("ingest", help="files to chunks")
    a.add_argument("input")
    a.add_argument("--output", required=True)
    a.add_argument("--chunk-size", type=int, default=800)
    a.add_argument("--chunk-overlap", type=int, default=100)
    a.add_argument("--non-recursive", action="store_true")
    b = kinds.add_parser("index", help="chunks to a saved index")
    b.add_argument("--data-dir", required=True)
    b.add_argument("--chunk-path")
    b.add_argument("--output", required=True)
    c = kinds.add_parser("ask", help="a question over chunks")
    c.add_argument("query")
    c.add_argument("--region")
    d = kinds.add_parser("serve", help="questions over HTTP")
    d.add_argument("--port", type=int, default=8000)
    for p in (c, d):
        p.add_argument("--data-dir", required=True)
        p.add_argument("--chunk-path")
        p.add_argument("--index", help="a saved index; without one it is built")
        p.add_argument("--sessions", help="the folder of sessions, by default below the data")
    c.add_argument("--session-id")
    o = parser.parse_args(args)
    spark = SparkSession.builder.appName(f"millrace {o.what}").getOrCreate()
    if o.what == "ingest":
        out = ingest(spark, o.input, o.output, not o.non_recursive, o.chunk_size, o.chunk_overlap).report
    else:
        chunks = records.read_chunks(spark, records.resolve(o.data_dir, o.chunk_path))
        if o.what == "index":
            built = index.build(chunks, "chunk_id", "chunk_text")
            built.save(o.output)
            out = index.summary(built)
        elif o.what == "serve":
            serve(spark, _engine(spark, chunks, o.index), o.sessions or f"{o.data_dir}/sessions", port=o.port).serve_forever()
            return 0
        elif o.session_id:
            out = _engine(spark, chunks, o.index).ask_in_session(spark, o.sessions or f"{o.data_dir}/sessions", o.session_id, o.query, o.region)
        else:
            out = _engine(spark, chunks, o.index).ask_many(spark.createDataFrame([(1, o.query)], "query_id int, query string").withColumn("region", F.lit(o.region).cast("string")))
    for row in out.toJSON().collect():  # one row
        print(json.dumps(json.loads(row), ensure_ascii=False, indent=2))
    return 0


def _engine(spark: SparkSession, chunks: DataFrame, saved: str | None) -> Engine:
    return Engine(chunks, index.LexicalIndex.load(spark, saved) if saved else None)


if __name__ == "__main__":
    raise SystemExit(main())

"""python -m tessella NAME DIR: run a query of the catalogue over a dataset folder and show, explain or write its result.

python -m tessella explain DIR --model-file FILE: explain cases of a dataset folder with a model that a search saved.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame

from tessella.plans import catalog, fits, report
from tessella.session import local_session
from tessella.sources import files, settings

log = logging.getLogger("tessella")


def explain_cases(args: argparse.Namespace) -> None:
    """Cases of the test split, explained by the saved model; texts come from the service that the settings name, or from the template."""
    spark = local_session("*")
    own = settings.load_settings(args.env_file)
    mode = settings.text_mode(own, args.force_local)
    call = settings.text_client(own, args.text_model) if mode == "api" else None
    out = args.out or files.scratch_path(spark, "cases")
    rows = fits.modelling_table(spark, args.dir).where("split = 'test'")
    report.explain_saved(spark, rows, args.model_file, "doc_id", "quality", args.sample_count, out, settings.run_key(), call)
    log.info("mode %s, written to %s", mode, out)
    report_table(files.read_table(spark, f"{out}/responses", "csv", report.RESPONSE_SCHEMA), args.rows)


def report_table(df: DataFrame, rows: int) -> None:
    print("\n".join(files.text_lines(df, rows)))


def main(argv: list[str] | None = None) -> None:
    queries = catalog.queries() | fits.queries()
    parser = argparse.ArgumentParser(prog="tessella", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("name", choices=[*sorted(queries), "explain"], metavar="NAME", help="a query of the catalogue, or explain")
    parser.add_argument("dir", help="folder of the Parquet tables")
    parser.add_argument("--rows", type=int, default=20, help="rows to show")
    parser.add_argument("--explain", action="store_true", help="print the plan instead")
    parser.add_argument("--out", help="write the result here instead")
    parser.add_argument("--format", default="parquet", choices=("parquet", "csv", "jsonl", "orc"))
    parser.add_argument("--model-file", help="explain: a model that a search saved")
    parser.add_argument("--sample-count", type=int, default=8, help="explain: cases")
    parser.add_argument("--text-model", help="explain: the text service's model")
    parser.add_argument("--force-local", action="store_true", help="explain: use the template whatever the settings say")
    parser.add_argument("--env-file", default=".env", help="explain: a file of NAME=value settings")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    if args.name == "explain":
        if not args.model_file:
            parser.error("explain needs --model-file")
        return explain_cases(args)
    df = queries[args.name](local_session("*"), args.dir)
    if args.explain:
        df.explain("formatted")
    elif args.out:
        files.write_table(df, args.out, args.format)
        log.info("written to %s", args.out)
    else:
        report_table(df, args.rows)


if __name__ == "__main__":
    main()

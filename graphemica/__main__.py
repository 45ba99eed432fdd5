"""Commands on corpora: ``python -m graphemica COMMAND --help``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.align import positional_cer
from .functions.mapper import Mapper
from .functions.similarity import distance_matrix, linkage
from .operators import datasets as ds
from .operators import network
from .operators import stats as st
from .operators.demap import Demapper
from .plans.session import ship
from .sources import sinks
from .sources import text as tx
from .sources.charsets import charsets


def _show(df: DataFrame, to: str | None, overwrite: bool = False) -> None:
    """To a folder of tab-separated lines, or to the screen."""
    if to and to not in ("stdout", "stderr"):
        sinks.write_tsv(df, to, overwrite)
        return
    out = sys.stderr if to == "stderr" else sys.stdout
    print("\t".join(df.columns), file=out)
    for row in df.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row), file=out)


def _corpus(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return tx.read_corpus(spark, a.files, strip=not a.keep_xml, all_xml=a.all_xml)


def alphabet(spark, a):
    _show(st.histogram(_corpus(spark, a)), a.output, a.overwrite)


def coverage(spark, a):
    _show(st.coverage(_corpus(spark, a), st.sets_named(spark, a.alphabets)), a.output, a.overwrite)


def merges(spark, a):
    _show(st.merge_cer(_corpus(spark, a), st.parse_merges(a.merges)), a.output, a.overwrite)


def information(spark, a):
    _show(st.information(_corpus(spark, a), "path", unit=a.unit), a.output, a.overwrite)


def tree(spark, a):
    for left, right, d, n in linkage(distance_matrix(spark, a.letters or charsets["ascii_letters"])):
        print(f"{left}\t{right}\t{d:.4f}\t{n}")


def map_corpus(spark, a):
    from .functions.mapper import llemmatize

    _show(llemmatize(_corpus(spark, a), charsets[a.alphabet], min_similarity=a.min_similarity), a.output, a.overwrite)


def page_text(spark, a):
    raw = tx.read_corpus(spark, a.files, strip=False)
    sinks_df = raw.select("path", tx.page_transcription(F.col("text"), ignore_deleted=not a.keep_deleted).alias("text"))
    if a.output:
        sinks.write_transcriptions(sinks_df, a.output, a.by_file, a.overwrite)
    else:
        for r in sinks_df.orderBy("path").toLocalIterator():
            print(r.text)


def _pairs(spark, a) -> DataFrame:
    return tx.read_pairs(spark, a.pairs, a.other).select(F.col("pred").alias("src"), F.col("gt").alias("tgt"))


def full_cer(spark, a):
    _show(ds.full_cer(_pairs(spark, a), ignore_above=a.ignore_above), a.output, a.overwrite)


def postcorrection_tsv(spark, a):
    _show(ds.postcorrection_pairs(_pairs(spark, a), a.min_length, a.most).select("sub", "tgt"), a.output, a.overwrite)


def train(spark, a):
    pairs = _pairs(spark, a) if a.pairs else ds.self_supervised(tx.lines(_corpus(spark, a), "path"), Mapper.from_alphabets(a.src or charsets["mes1"], charsets[a.alphabet], spark=spark))
    keyed = pairs.select(F.xxhash64("src", "tgt").alias("key"), "src", "tgt").dropDuplicates(["key"])
    if a.many_to_more:
        keyed = ds.many_to_more(keyed)  # any lengths: the use of the sequence models of either kind
    learn, test = ds.split(keyed, a.ratio, "key")
    if a.network:
        found = network.fit(learn, test, a.epochs, a.width, start=network.Network.load(spark, a.resume) if a.resume else None)
        found.save(spark, a.model, a.overwrite)
        _show(found.history_table(spark), None)
        return
    model = Demapper.fit(learn, a.width, pieces="parts" if a.many_to_more else None)
    if not a.many_to_more:
        model.history = model.accuracy(test, "key").select(F.lit(1).alias("epoch"), "n", "correct", "accuracy")
    model.save(a.model, a.overwrite)
    if model.history is not None:
        _show(model.history, None)


def report(spark, a):
    _show(spark.read.parquet(f"{a.model}/history").orderBy("epoch"), a.output, a.overwrite)


def infer(spark, a):
    rows = spark.read.text(a.files).select(F.monotonically_increasing_id().alias("key"), F.col("value").alias("src"))
    model = network.Network.load(spark, a.model) if a.network else Demapper.load(spark, a.model)
    out = model.transform(rows, "key").orderBy("key")
    _show(out.select("text", "confidence") if a.confidence else out.select("text"), a.output, a.overwrite)


def infer_column(spark, a):
    """A model applied to one field of tab-separated lines."""
    rows = spark.read.text(a.files).select(F.monotonically_increasing_id().alias("key"), F.col("value").alias("line"))
    fields = F.split("line", "\t")
    model = Demapper.load(spark, a.model)
    fixed = model.transform(rows.select("key", F.get(fields, F.lit(a.column)).alias("src")).filter("src is not null"), "key").select("key", "text")
    out = rows.join(fixed, "key", "left").orderBy("key")
    line = ds.correct_column(F.col("line"), a.column, lambda x: F.coalesce(F.col("text"), x))
    _show(out.select(line.alias("line")), a.output, a.overwrite)


def train_aligned(spark, a):
    """A demapper from aligned OCR files, cut at long gaps of the truth."""
    pieces = tx.split_at_gaps(tx.read_icdar(tx.read_corpus(spark, a.files, strip=False)), a.max_insertions, a.min_length)
    keyed = pieces.select(F.xxhash64("path", "piece").alias("key"), F.translate("ocr", "@", "").alias("src"), F.translate("gt", "@", "").alias("tgt"), tx.aligned_parts(F.col("ocr"), F.col("gt")).alias("parts"))
    learn, test = ds.split(keyed, a.ratio, "key")
    model = Demapper.fit(learn, a.width, pieces="parts")
    made = model.transform(test, "key").join(test.select("key", "tgt", "src"), "key")
    before, after = (F.try_divide(F.sum(F.levenshtein(c, "tgt")), F.sum(F.length("tgt"))) for c in ("src", "text"))
    model.history = made.agg(F.lit(1).alias("epoch"), F.count("*").alias("n"), before.alias("cer_before"), after.alias("cer_after"))
    model.save(a.model, a.overwrite)
    _show(model.history, None)


def cer(spark, a):
    p = _pairs(spark, a)
    _show(p.agg(F.avg(positional_cer(F.col("src"), F.col("tgt"))).alias("positional_cer"), F.try_divide(F.sum(F.levenshtein("src", "tgt")), F.sum(F.length("tgt"))).alias("edit_cer")), a.output, a.overwrite)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="graphemica", description=__doc__)
    sub = p.add_subparsers(required=True, metavar="COMMAND")

    def command(name: str, f, text: str, corpus: bool = False, pairs: bool = False) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text, description=text)
        c.set_defaults(run=f)
        c.add_argument("--output", help="a folder; the screen without it")
        c.add_argument("--overwrite", action="store_true")
        if corpus:
            c.add_argument("files", nargs="*" if pairs else "+", help="globs and paths")
            c.add_argument("--keep-xml", action="store_true", help="do not strip XML files")
            c.add_argument("--all-xml", action="store_true", help="strip every file")
        if pairs:
            c.add_argument("--pairs", required=not corpus, help="tab-separated pairs (- for standard input), or the first of two files of lines")
            c.add_argument("--other", help="the second file")
        return c

    command("alphabet", alphabet, "the characters of a corpus and their counts", True)
    command("coverage", coverage, "how far character sets cover a corpus", True).add_argument("--alphabets", default="all")
    command("merges", merges, "the share of characters that merging changes", True).add_argument("--merges", required=True, help="[('u', 'v'), ...]")
    command("information", information, "Hartley and Shannon information of each file", True).add_argument("--unit", default="codepoint", choices=["codepoint", "utf16"])
    command("tree", tree, "clusters of characters by similarity").add_argument("--letters")
    c = command("map", map_corpus, "a corpus mapped onto a character set", True)
    c.add_argument("--alphabet", default="ascii")
    c.add_argument("--min-similarity", type=float, default=0.3)
    c = command("page-text", page_text, "the transcriptions of PAGE documents")
    c.add_argument("files", nargs="+")
    c.add_argument("--keep-deleted", action="store_true")
    c.add_argument("--by-file", action="store_true")
    command("cer", cer, "positional and edit error rates of pairs", pairs=True)
    command("full-cer", full_cer, "edit error rate of pairs, with kinds of errors", pairs=True).add_argument("--ignore-above", type=float, default=1.0)
    c = command("postcorrection-tsv", postcorrection_tsv, "pairs that differ by substitutions only", pairs=True)
    c.add_argument("--min-length", type=int, default=50)
    c.add_argument("--most", type=float, default=0.2)
    c = command("train", train, "a demapper from pairs, or from a corpus and a character set", True, True)
    c.add_argument("--model", required=True)
    c.add_argument("--width", type=int, default=2)
    c.add_argument("--ratio", type=float, default=0.8)
    c.add_argument("--alphabet", default="ascii")
    c.add_argument("--src")
    c.add_argument("--many-to-more", action="store_true", help="pairs of unequal length, by alignment")
    c.add_argument("--network", action="store_true", help="a network trained in epochs in place of counts")
    c.add_argument("--epochs", type=int, default=5)
    c.add_argument("--resume", help="a network to go on from")
    command("report", report, "what a demapper's training measured").add_argument("--model", required=True)
    c = command("infer", infer, "lines corrected by a demapper")
    c.add_argument("files", nargs="+")
    c.add_argument("--model", required=True)
    c.add_argument("--confidence", action="store_true")
    c.add_argument("--network", action="store_true", help="the model is a network")
    c = command("infer-column", infer_column, "one field of tab-separated lines corrected by a demapper")
    c.add_argument("files", nargs="+")
    c.add_argument("--model", required=True)
    c.add_argument("--column", type=int, default=0)
    c = command("train-aligned", train_aligned, "a demapper from aligned OCR files of three lines, held against files left out")
    c.add_argument("files", nargs="+")
    c.add_argument("--model", required=True)
    c.add_argument("--width", type=int, default=2)
    c.add_argument("--ratio", type=float, default=0.8)
    c.add_argument("--max-insertions", type=int, default=4)
    c.add_argument("--min-length", type=int, default=10)
    a = p.parse_args(argv)
    a.run(ship(SparkSession.builder.appName("graphemica").getOrCreate()), a)


if __name__ == "__main__":
    main()

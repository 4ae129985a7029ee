"""Score a mention TSV with a named scorer, write ``ID,A,B,NEITHER`` and print the log loss.

    python -m mentionkit.cli --input mentions.tsv --output predictions_dir --scorer cascade

``--plugin my_scorers`` imports a module first, which may register scorers of its own by name.
``--train ranker --model folder`` fits a model on the input instead and saves it;
``--scorer trained:folder`` scores with it, in any later process.
"""

from __future__ import annotations

import argparse
import importlib

from mentionkit.operators import scorers as R
from mentionkit.plans import trained as T
from mentionkit.plans.fixture import load_tsv_context
from mentionkit.session import build_session
from mentionkit.sources import tsv


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("--input", required=True, help="mention TSV (header, tab separated)")
    ap.add_argument("--output", help="directory for the prediction CSV")
    ap.add_argument("--train", choices=["ranker", "boosting"], help="fit this kind of scorer on the input and save it")
    ap.add_argument("--model", help="folder of the scorer that --train saves")
    ap.add_argument("--any-code", action="store_true", help="accept a scorer that another version of the code trained")
    ap.add_argument("--scorer", default="cascade", help="a registered scorer's name")
    ap.add_argument("--plugin", action="append", default=[], help="module that registers scorers (repeatable)")
    args = ap.parse_args(argv)
    for module in args.plugin:
        importlib.import_module(module)
    if not (args.model if args.train else args.output):
        ap.error("--train needs --model, scoring needs --output")
    trained = args.scorer.startswith(T.PREFIX)
    if not trained and args.scorer not in R.scorer_names():
        ap.error(f"no scorer {args.scorer!r}; there are {', '.join(R.scorer_names())}")
    spark = build_session()
    if args.train:
        saved = T.train(load_tsv_context(spark, args.input), args.train)
        T.save(spark, saved, args.model)
        print(f"saved {args.model}")
        return
    if trained:
        T.register(spark, args.scorer, args.any_code)
    cx = load_tsv_context(spark, args.input)
    tsv.write_predictions(R.score_context(cx, args.scorer), args.output)
    score = tsv.score_files(spark, args.input, args.output).first()
    print(score["log_loss"])


if __name__ == "__main__":
    main()

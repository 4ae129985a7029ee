import json
import os
import subprocess
import sys

import pytest

from mentionkit.operators import scorers as R
from mentionkit.plans import trained as T
from mentionkit.plans.fixture import load_tsv_context
from mentionkit.sources import tsv
from mentionkit.sources.staging import STAGING_VERSION

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def mentions(spark, tmp_path_factory):
    """A mention TSV of 60 passages, the true name always the one after the pronoun's verb."""
    rows = ["ID\tText\tPronoun\tPronoun-offset\tA\tA-offset\tA-coref\tB\tB-offset\tB-coref\tURL"]
    for i in range(60):
        first, second = ("Anna", "Bella") if i % 2 else ("Clara", "Dora")
        text = f"{first} met {second} in town. Then she saw {'the old' if i % 3 else 'a'} house near {first}."
        rows.append("\t".join(map(str, [f"test-{i}", text, "she", text.index("she"), first, 0, i % 3 == 0, second, text.index(second), i % 3 == 1, "u"])))
    path = tmp_path_factory.mktemp("trained") / "mentions.tsv"
    path.write_text("\n".join(rows) + "\n")
    return str(path)


def test_a_second_process_scores_with_the_saved_model(spark, mentions, tmp_path):
    cx = load_tsv_context(spark, mentions)
    saved = T.train(cx, "ranker", patience=3)
    T.save(spark, saved, f"{tmp_path}/model")
    done = subprocess.run([sys.executable, "-m", "mentionkit.cli", "--input", mentions, "--output", f"{tmp_path}/out",
                           "--scorer", f"trained:{tmp_path}/model"], cwd=ROOT, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-800:]
    other = {r.id: (r.p_a, r.p_b, r.p_neither) for r in tsv.read_predictions(spark, f"{tmp_path}/out").collect()}
    own = {r.id: (r.p_a, r.p_b, r.p_neither) for r in T.score(cx, saved).collect()}
    assert len(own) == 60 and other.keys() == own.keys()
    assert all(other[i] == pytest.approx(own[i], abs=1e-9) for i in own)


def test_boosting_by_name_and_what_loading_refuses(spark, mentions, tmp_path):
    cx = load_tsv_context(spark, mentions)
    saved = T.train(cx, "boosting", rounds=2, depth=2)
    path = f"{tmp_path}/trees"
    T.save(spark, saved, path)
    T.register(spark, f"trained:{path}")
    again = T.load(spark, path)
    assert again.trained["rounds"] == 2 and again.code == STAGING_VERSION and again.width == 0
    assert sorted(R.score_context(cx, f"trained:{path}").collect()) == sorted(T.score(cx, saved).collect())
    text = json.loads(spark.read.text(path, wholetext=True).first().value)
    for change, message in (({"code": "other"}, "trained with code"), ({"kind": "rules"}, "unknown kind"),
                            ({"layout": {"size": 1}}, "other features")):
        bad = f"{tmp_path}/bad-{message[:5]}"
        spark.createDataFrame([(json.dumps({**text, **change}),)], "value string").coalesce(1).write.text(bad)
        with pytest.raises(ValueError, match=message):
            T.load(spark, bad)
    assert T.load(spark, f"{tmp_path}/bad-train", any_code=True).code == "other"
    with pytest.raises(ValueError, match="dimensions"):
        T.score(cx, T.Saved("boosting", saved.model, 5, {}))
    with pytest.raises(ValueError):
        T.train(cx, "nothing")

"""The batched plan: one language for each recording, no timestamps in prompts, marks as words in the anomaly score."""

import numpy as np
from pyspark.sql import functions as F

from sonara.config import TranscribeConfig
from sonara.functions import scores
from sonara.operators import attempts
from sonara.plans import transcribe


def test_marks_count_as_words_only_if_they_are_one_character(spark):
    said = [" .", "?!", "", "  ", "·", "([{", "word", "\t!\n", "。"]
    df = spark.createDataFrame([(w,) for w in said], "w string")
    found = [r.x for r in df.select(scores.is_punctuation_word(F.col("w")).alias("x")).collect()]
    want = [w.strip() == "" or w.strip() in set(scores.PUNCTUATION) for w in said]
    assert found == want == [True, False, True, True, False, False, False, True, True]
    heard = attempts.Heard(0, 1, [(0.0, 0.05, "?!", 0.1)] * 3 + [(0.0, 0.5, " .", 0.9)])
    assert attempts.is_anomaly(heard) and not attempts.is_anomaly(attempts.Heard(0, 1, [(0.0, 0.01, " .", 0.01)] * 4))


class _Recorder:
    """A model that notes what it is asked."""

    n_mels = 80

    def __init__(self):
        self.detected, self.prompts = [], []

    def detect(self, mels):
        self.detected.append(len(mels))
        return [("en" if len(self.detected) == 1 else "de", 0.9)] * len(mels)

    def decode(self, mels, prompts, temperature, options):
        self.prompts += prompts
        raise StopIteration


def test_a_recording_is_detected_once(tmp_path, monkeypatch):
    import pandas as pd

    class Tok:
        eot, time_begin = 10, 100

        def encode(self, text):
            return [1]

        def prompt(self, lang, task, previous, hotwords, prefix, timestamps):
            return [lang, timestamps]

    model = _Recorder()
    monkeypatch.setattr(transcribe, "options", lambda *a: None)
    batch = pd.DataFrame({"rec_id": [1, 1, 2, 2], "win": [0, 1, 0, 1], "offset": [0.0, 30.0, 0.0, 30.0], "duration": [1.0] * 4, "pcm": [np.zeros(400, dtype=np.float32)] * 4})
    try:
        transcribe._decode_batch(batch, model, Tok(), TranscribeConfig(), None)
    except StopIteration:
        pass
    assert model.detected == [2] and model.prompts == [["en", False]] * 4


def test_the_batched_plan_hands_samples_to_python_once(spark):
    from sonara.catalogue import toy_tokenizer
    from sonara.plans import scoring, stub

    rows = spark.createDataFrame([(1, [0.0] * 10)], "rec_id bigint, pcm array<float>")
    plan = transcribe.batched_plan(rows, scoring.EnergyScorer, stub.StubModel, toy_tokenizer())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1

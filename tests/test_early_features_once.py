"""early_features searches once: the checks for missing records do not run the search again."""

import contextlib
import io

import __spark_entry__ as entry
from samewise.functions import text
from samewise.operators import features
from tests.test_queries import SMALL


def test_early_features_searches_once(spark, monkeypatch):
    given, normalised, plain = [], [], text.normalised
    monkeypatch.setattr(text, "normalised", lambda df: normalised.append(1) or plain(df))
    monkeypatch.setattr(features, "early_features", lambda pairs, records: given.append(pairs) or pairs)
    entry.queries()["early_features"](spark, SMALL)
    with contextlib.redirect_stdout(out := io.StringIO()):
        given[0].explain()
    assert len(normalised) == 1 and "Exchange" not in out.getvalue() and "Existing" in out.getvalue()

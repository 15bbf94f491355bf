"""An optional statistical layer. Without its library it finds nothing, and says so by active()."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.policy import DEFAULT, NER_LABELS, Policy
from . import names as N
from .structured import SPAN, empty_spans

MODELS = ("en_core_web_lg", "en_core_web_sm")
SCORE = 0.6


#: What finds entities: texts -> for each text (start, end, label) of its entities. A model of one's own may take the library's place.
Model = Callable[[list[str]], Iterable[list[tuple[int, int, str]]]]


@functools.lru_cache(maxsize=2)
def _library(name: str) -> Model | None:
    try:
        import spacy
    except ImportError:
        return None
    for wanted in (name, *MODELS):
        try:
            nlp = spacy.load(wanted, disable=["lemmatizer", "textcat"])
        except OSError:
            continue
        return lambda texts: ([(e.start_char, e.end_char, e.label_) for e in doc.ents] for doc in nlp.pipe(texts))
    return None


def _model(model: str | Model) -> Model | None:
    return _library(model) if isinstance(model, str) else model


def active(model: str | Model = MODELS[0]) -> bool:
    return _model(model) is not None


def allowed(span: Column, policy: Policy = DEFAULT) -> Column:
    """People must be shaped like names; organisations neither public bodies nor legislation. Other types pass."""
    return (
        F.when(span["pii_type"] == "PERSON", N.is_name_like(span["text"], policy))
        .when(span["pii_type"] == "ORGANISATION", ~N.is_public_body(span["text"], policy) & ~N.is_legislation(span["text"], policy))
        .otherwise(True)
    )


def entities(text: str, model: str | Model = MODELS[0], policy: Policy = DEFAULT) -> Column:
    """Spans of labels that map to a type, as far as they are allowed(); none without a model. Offsets count code points."""
    if not active(model):
        return empty_spans()

    @F.pandas_udf(SPAN)
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = _model(model)
        for part in parts:
            texts = list(part.fillna(""))
            yield pd.Series(
                [
                    [{"start": a, "end": b, "pii_type": NER_LABELS[label], "text": t[a:b], "score": SCORE, "source": "SpacyRecognizer"} for a, b, label in each if label in NER_LABELS]
                    for t, each in zip(texts, run(texts), strict=True)
                ]
            )

    return F.filter(found(F.col(text)), lambda s: allowed(s, policy))

"""YAML text from JSON text, the one rendering step that needs Python."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

# JSON text whose strings neither dumper writes in double quotes: printable
# characters, quotes, backslashes, and line breaks without a space beside them.
# For these the C dumper gives the same text as the Python one, ten times
# faster; they differ in where they fold double-quoted strings.
PLAIN_CHARS = r"[ -!#-\[\]-~\u00a1-\u1fff\u2030-\ud7ff\ue000-\ufdff]"
EASY = re.compile(rf'(?:{PLAIN_CHARS}++|"|\\[n"\\/])*+')
SPACED_BREAK = re.compile(r"[ ]\\n|\\n[ ]")


def yaml_dumper() -> Callable[[str], str]:
    """Function from JSON text to block-style YAML with key order kept."""
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("YAML output needs the PyYAML package on the workers") from error

    exact = yaml.Dumper
    fast = getattr(yaml, "CDumper", exact)

    def dump(text: str) -> str:
        easy = EASY.fullmatch(text) is not None and SPACED_BREAK.search(text) is None
        return yaml.dump(
            json.loads(text), Dumper=fast if easy else exact,
            default_flow_style=False, sort_keys=False, allow_unicode=True,
        )

    return dump


def json_to_yaml(document: Column) -> Column:
    """YAML text of a JSON column; null stays null. Quoting and folding are
    those of PyYAML's default dumper."""

    @F.pandas_udf("string")
    def to_yaml(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dump = yaml_dumper()
        for texts in batches:
            yield texts.map(dump, na_action="ignore")

    return to_yaml(document)

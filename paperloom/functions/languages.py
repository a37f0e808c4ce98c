"""Language codes to names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language codes and their names.
LANGUAGE_NAMES = {
    "zh-cn": "Chinese (Simplified)",
    "zh-tw": "Chinese (Traditional)",
    "es": "Spanish",
    "fr": "French",
    "de": "German",
    "ja": "Japanese",
    "ko": "Korean",
    "ru": "Russian",
    "ar": "Arabic",
    "hi": "Hindi",
    "pt": "Portuguese",
    "it": "Italian",
    "nl": "Dutch",
    "sv": "Swedish",
    "da": "Danish",
    "no": "Norwegian",
    "fi": "Finnish",
}


def language_name(code: Column, names: Mapping[str, str] = LANGUAGE_NAMES) -> Column:
    """Name of a code, the code in capitals when unknown.

    The table is a dictionary in the program, so it goes into the plan as a map
    literal and the lookup needs no join.
    """
    pairs = [F.lit(text) for pair in names.items() for text in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.upper(code))

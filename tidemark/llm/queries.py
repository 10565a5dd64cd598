"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op4_bpe
from .centroids import ORACLE as CENTROIDS
from .centroids import op11_centroids
from .gru import op6_gru
from .langid import op7_langid
from .linededup import ORACLE as LINEDEDUP
from .linededup import op8_linededup
from .media import op3_media
from .minhash import op9_minhash
from .packing import op5_packing
from .phrases import ORACLE as PHRASES
from .phrases import op12_phrases
from .pii import op2_pii
from .vectors import op13_vectors
from .warc import ORACLE as WARC
from .warc import op10_warc
from .winnowing import op1_winnowing


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_winnowing": op1_winnowing,
        "op2_pii": op2_pii,
        "op3_media": op3_media,
        "op4_bpe": op4_bpe,
        "op5_packing": op5_packing,
        "op6_gru": op6_gru,
        "op7_langid": op7_langid,
        "op8_linededup": op8_linededup,
        "op9_minhash": op9_minhash,
        "op10_warc": op10_warc,
        "op11_centroids": op11_centroids,
        "op12_phrases": op12_phrases,
        "op13_vectors": op13_vectors,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_linededup": LINEDEDUP, "op10_warc": WARC, "op11_centroids": CENTROIDS, "op12_phrases": PHRASES}

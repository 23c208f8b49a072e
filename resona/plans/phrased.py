"""The tables' own texts with domain phrases in place of some words, for rules on words that the tables don't hold.

A word is replaced where its MD5, modulo ONE_IN, falls on a phrase's place, so the phrases stand wherever their words
do: in any neighbourhood, any number of times, and as many as the texts have words. Spark and SQL do the same.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PHRASES = [
    "değil", "yok", "ama", "ancak", "bpfi", "iç bilezik", "Inner race fault.", "outer race", "Dış bilezik", "BPFO", "bilya", "kafes", "unbalance", "Dengesizlik",
    "misalignment", "eksen kaçıklığı", "hizasızlık", "looseness", "rezonans", "vane pass", "iso 10816", "ISO", "2X", "1x rpm", "fft", "n", "zone A", "Zone b", "zone c.",
    "zone  d", "unlike", "in contrast", "sağlamdır", "tespit edilmedi", "fark", "vs", "veya", "ya da", "mi", "mı", "nedir", "İÇ BİLEZİK", "severity", "stage 2 of", "Orbit",
    "courtesy of", "Bode", "logo", "pencere", "1st cycle", "karşılaştırıldığında", "yoksa", "-ama-", "no,", "rağmen", "Hanning",
]
ONE_IN = 400
#: SQL: as phrased(), of a column text.
PHRASED = (
    f"array_to_string(list_transform(string_split(coalesce(text, ''), ' '), lambda w: coalesce([{', '.join(repr(p) for p in PHRASES)}]"
    f"[CAST(CAST('0x' || substr(md5(w), 1, 7) AS BIGINT) % {ONE_IN} + 1 AS INTEGER)], w)), ' ')"
)


def phrased(text: Column) -> Column:
    """The text, split at spaces, with phrases for some words; null is empty."""
    place = lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 7), 16, 10).cast("long") % ONE_IN + 1).cast("int")
    words = F.split(F.coalesce(text, F.lit("")), " ")
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(F.array(*map(F.lit, PHRASES)), place(w)), w)), " ")

"""Binary payloads: fresh bytes whose kind follows the file name of the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.draw import Draws
from veilspark.functions.generators import extension
from veilspark.functions.templates import filler

# First bytes per file kind: fixed values.
SIGNATURES = {
    "pdf": "255044462d312e340a",
    "docx": "504b030414000600",
    "xlsx": "504b030414000600",
    "doc": "d0cf11e0a1b11ae1",
    "msg": "d0cf11e0a1b11ae1",
    "png": "89504e470d0a1a0a",
    "jpg": "ffd8ffe000104a464946",
    "jpeg": "ffd8ffe000104a464946",
    "tif": "49492a00",
    "tiff": "49492a00",
}
IMAGE = SIGNATURES["jpg"]


def mask_blob(payload: Column, file_name: Column, draws: Draws, retain_null: bool = True) -> Column:
    """Text, HTML or RTF filler, or a signature followed by keyed bytes; other kinds become an image."""
    kind = F.lower(extension(file_name))
    text = filler(4).value(draws)
    noise = F.concat(*[draws.digest(f"b{k}") for k in range(4)])
    signature = F.lit(IMAGE)
    for name, start in SIGNATURES.items():
        signature = F.when(kind == name, F.lit(start)).otherwise(signature)
    fresh = (
        F.when(kind == "txt", F.encode(text, "UTF-8"))
        .when(kind.isin("htm", "html"), F.encode(F.concat(F.lit("<html><body><p>"), text, F.lit("</p></body></html>")), "UTF-8"))
        .when(kind == "rtf", F.encode(F.concat(F.lit("{\\rtf1\\ansi "), text, F.lit("}")), "UTF-8"))
        .otherwise(F.unhex(F.concat(signature, noise)))
    )
    return F.when(payload.isNotNull(), fresh) if retain_null else fresh

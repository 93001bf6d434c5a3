"""The queries of this subpackage, by name; ``SQL`` has DuckDB SQL where SQL can express one."""

from __future__ import annotations

from . import alignment, bpe, language, media, minhash, mixing, neighbours, order, pieces, scoring, secrets, substrings, whitening

QUERIES = {
    "op1_secrets": secrets.op1,
    "op2_language": language.op2,
    "op3_bpe": bpe.op3,
    "op4_media": media.op4,
    "op5_mixing": mixing.op5,
    "op6_minhash": minhash.op6,
    "op7_substrings": substrings.op7,
    "op8_neighbours": neighbours.op8,
    "op9_order": order.op9,
    "op10_scoring": scoring.op10,
    "op11_pieces": pieces.op11,
    "op12_alignment": alignment.op12,
    "op13_whitening": whitening.op13,
}
SQL: dict[str, str] = {"op1_secrets": secrets.op1_sql(), "op7_substrings": substrings.OP7_SQL}

"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from chronoframe.llm import (
    bpe,
    dartminhash,
    flac,
    packing,
    pii,
    rpforest,
    secrets,
    toxicity,
    urls,
    wavelet,
)

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_secrets": secrets.op2_secrets,
    "op3_flac": flac.op3_flac,
    "op4_urls": urls.op4_urls,
    "op5_minhash": dartminhash.op5_minhash,
    "op6_neighbours": rpforest.op6_neighbours,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_bpe": bpe.op8_bpe,
    "op9_packing": packing.op9_packing,
    "op10_wavelet": wavelet.op10_wavelet,
}
ORACLES = {
    "op1_pii": pii.oracle(),
    "op2_secrets": secrets.oracle(),
}

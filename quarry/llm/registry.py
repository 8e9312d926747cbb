"""Queries and SQL of this subpackage."""

from __future__ import annotations

from quarry.llm import bpe, jaccard, leaks, lzprint, merkle, mixing, periodic, pii, quality, repeats, sharding, sstable, voronoi


def queries() -> dict:
    found = [
        voronoi.op1_voronoi_knn,
        quality.op2_factorisation_machine,
        sstable.op3_sstable_shards,
        jaccard.op4_token_group_jaccard,
        lzprint.op5_lz_fingerprints,
        repeats.op6_repeated_strings,
        mixing.op7_low_discrepancy_mix,
        pii.op8_weak_supervision_pii,
        sharding.op9_byte_shards,
        bpe.op10_byte_bpe,
        periodic.op11_periodic_runs,
        merkle.op12_merkle_manifest,
        leaks.op13_trigram_secrets,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_voronoi_knn": voronoi.OP1_SQL}

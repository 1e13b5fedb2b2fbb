"""The queries of this subpackage, by name, with SQL where it can express them."""

from __future__ import annotations

from tarn.llm import blockjoin, flatgraph, importance, lattice, packing, pieces, quality, secrets, simhash, spelling, syncmers, token_files, toxicity


def queries() -> dict:
    return {
        "op1_closed_syncmers": syncmers.query,
        "op2_lattice_likelihood": lattice.query,
        "op3_block_matrix_join": blockjoin.query,
        "op4_string_kernel_toxicity": toxicity.query,
        "op5_best_fit_packing": packing.query,
        "op6_password_guess_cost": secrets.query,
        "op7_simhash_near_dedup": simhash.query,
        "op8_quadratic_discriminant": quality.query,
        "op9_relational_lattice": pieces.query,
        "op10_token_files": token_files.query,
        "op11_symmetric_delete": spelling.query,
        "op12_importance_resampling": importance.query,
        "op13_flat_graph": flatgraph.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_block_matrix_join": blockjoin.SQL,
        "op11_symmetric_delete": spelling.SQL,
        "op12_importance_resampling": importance.SQL,
        "op13_flat_graph": flatgraph.SQL,
    }

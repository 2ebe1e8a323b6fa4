"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import conversations, fill_middle, graph_search, host_reputation, impact_search, jaccard_join, mixing, packing, rendezvous, simple8b, spotsigs, substrings, toxicity


def queries() -> dict:
    return {
        "op1_spotsigs": spotsigs.op1_spotsigs,
        "op2_super_kmers": substrings.op2_super_kmers,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_best_fit_packing": packing.op4_best_fit_packing,
        "op5_graph_search": graph_search.op5_graph_search,
        "op6_rendezvous": rendezvous.op6_rendezvous,
        "op7_mixing": mixing.op7_mixing,
        "op8_simple8b": simple8b.op8_simple8b,
        "op9_host_reputation": host_reputation.op9_host_reputation,
        "op10_jaccard_join": jaccard_join.op10_jaccard_join,
        "op11_conversations": conversations.op11_conversations,
        "op12_impact_search": impact_search.op12_impact_search,
        "op13_fill_middle": fill_middle.op13_fill_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_spotsigs": spotsigs.OP1_SQL, "op2_super_kmers": substrings.OP2_SQL, "op6_rendezvous": rendezvous.OP6_SQL, "op9_host_reputation": host_reputation.OP9_SQL, "op10_jaccard_join": jaccard_join.OP10_SQL, "op11_conversations": conversations.OP11_SQL, "op12_impact_search": impact_search.OP12_SQL, "op13_fill_middle": fill_middle.OP13_SQL}

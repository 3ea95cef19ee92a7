"""Schemas and fixed values of the transfer pipeline."""

from __future__ import annotations

#: Columns of the raw and derived tables, all raw ones read as text.
RAW_BLOCK_COLUMNS = ("block_hash", "parent_hash", "block_number", "timestamp", "chain_id")
RAW_TRANSFER_COLUMNS = ("block_number", "transfer_index", "transaction_hash", "from_address", "to_address", "value_binary", "chain_id")

SCHEMAS = {
    "abstract_block": "block_sid string, block_number bigint, timestamp bigint",
    "abstract_transaction": "tx_sid string, tx_hash string, block_sid string",
    "abstract_token_transfer": "transfer_sid string, transfer_index int, amount string, category string, tx_sid string, spender_address_sid string, receiver_address_sid string, token_sid string",
    "abstract_account": "account_sid string, address string, type string",
    "abstract_token": "token_sid string, token_address string, token_symbol string, token_standard string, token_decimals int",
}

#: The token table's only row.
NATIVE_TOKEN = ("1_native", "", "ETH", "native", 18)

#: Accounts left out of the graph.
BLACKLIST = (
    "1_0x0000000000000000000000000000000000000000",
    "1_0x000000000000000000000000000000000000dead",
    "1_0xeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeee",
)
MIN_AMOUNT = 10**12

#: Columns of the feature table, in its order.
NODE_FEATURES = ("in_degree", "out_degree", "in_transfer_count", "out_transfer_count", "total_input_amount", "total_output_amount", "balance_proxy")
MOTIF_FEATURES = ("self_loop_count", "two_node_loop_count", "two_node_loop_amount", "two_node_loop_tx_count", "triangle_loop_count", "triangle_loop_amount", "triangle_loop_tx_count")
EGONET_FEATURES = ("egonet_node_count", "egonet_edge_count", "egonet_density")
ID_COLUMNS = ("node", "address", "is_infra", "chain_id", "year", "month")

#: Descriptions of the rules.
RULE_TEXTS = {
    "H1": "H1: Aggregates from many sources and forwards almost unchanged to few addresses. May indicate ransomware or scam fund routing.",
    "H2": "H2: Aggregates from many sources but shows no outgoing transfers. May indicate scam fund storage or ransomware holding address.",
    "H3": "H3: Receives funds from a single source and distributes to many addresses. May indicate laundering or scam profit distribution.",
    "H4": "H4: Receives from many sources and distributes to many others with minimal balance retained. Possible mixer or laundering relay.",
    "H5": "H5: Participates in closed two-node loops with high value or frequent transfers. May indicate wash trading or self-laundering.",
    "H6": "H6: Participates in closed triangle-shaped loops with high value or frequent transfers. May indicate self-laundering or obfuscation.",
}
#: Score columns and the order of the result table.
RULES = tuple(RULE_TEXTS)
SCORES = ("rule_score_raw", "rule_score_100", "mahalanobis_distance_stats_score_100", "iforest_stats_score_100", "final_score_0_100", "final_score_top_percent", "final_score_top_percent_display")
RESULT_COLUMNS = (*ID_COLUMNS, *NODE_FEATURES, *MOTIF_FEATURES, *EGONET_FEATURES, *[c for r in RULES for c in (f"{r}_flag", f"{r}_description")], "mahalanobis_distance", "iforest_score", *SCORES)

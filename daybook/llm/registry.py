"""The queries of the training-data operators, and their SQL where SQL can express them."""

from daybook.llm.chat_format import op13_chat_format, op13_sql
from daybook.llm.collocations import op11_collocations, op11_sql
from daybook.llm.decontamination import op6_decontamination, op6_sql
from daybook.llm.jaccard_join import op3_jaccard_join, op3_sql
from daybook.llm.katz import op8_katz
from daybook.llm.license_scan import op7_license_scan, op7_sql
from daybook.llm.packing import op9_packing
from daybook.llm.prefix_trie import op12_prefix_trie, op12_sql
from daybook.llm.quality_rules import op1_quality_rules, op1_sql
from daybook.llm.secret_scan import op2_secret_scan
from daybook.llm.sharding import op4_sharding
from daybook.llm.warc import OP5_SQL, op5_warc
from daybook.llm.weak_labels import op10_weak_labels


def queries() -> dict:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_secret_scan": op2_secret_scan,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_sharding": op4_sharding,
        "op5_warc": op5_warc,
        "op6_decontamination": op6_decontamination,
        "op7_license_scan": op7_license_scan,
        "op8_katz": op8_katz,
        "op9_packing": op9_packing,
        "op10_weak_labels": op10_weak_labels,
        "op11_collocations": op11_collocations,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_chat_format": op13_chat_format,
    }


def oracle_sql() -> dict:
    return {
        "op1_quality_rules": op1_sql(),
        "op3_jaccard_join": op3_sql(),
        "op5_warc": OP5_SQL,
        "op6_decontamination": op6_sql(),
        "op7_license_scan": op7_sql(),
        "op11_collocations": op11_sql(),
        "op12_prefix_trie": op12_sql(),
        "op13_chat_format": op13_sql(),
    }

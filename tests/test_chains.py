"""Relocation chains: a flattened count moved by a later split, a split detail merged back."""

import pytest

from migrata.operators.transforms import apply_log
from migrata.plans.verify import grade
from migrata.sources.generate import generate
from migrata.spec import Schema, check_preconditions, log_from_dicts

SCHEMA = Schema.from_dict({
    "entities": {
        "Account": {"fields": {"id": {"kind": "id"}, "name": {"kind": "text"}, "tier": {"kind": "enum",
                                                                                       "values": ["a", "b"]},
                               "score": {"kind": "number"}, "note": {"kind": "text"},
                               "items": {"kind": "nested", "of": "ItemBlock"}}},
        "Invoice": {"fields": {"id": {"kind": "id"}, "account_id": {"kind": "ref", "target": "Account"},
                               "amount": {"kind": "number"}, "memo": {"kind": "text"},
                               "paid": {"kind": "bool"}}},
    },
    "nested_blocks": {"ItemBlock": {"fields": {"label": {"kind": "text"}, "qty": {"kind": "number"}}}},
})
BLOCKS = {"ItemBlock": ["label", "qty"]}


def _check(spark, steps):
    log = log_from_dicts(steps)
    src = {k: v.cache() for k, v in generate(spark, SCHEMA, n=9, seed=5).items()}
    dest = apply_log(src, log, blocks=BLOCKS)
    r = grade(SCHEMA, log, src, dest)
    assert r["total"] == pytest.approx(100.0, abs=1e-6), r
    assert grade(SCHEMA, log, src, {})["total"] <= 25


def test_flatten_then_split_moves_count(spark):
    _check(spark, [
        {"type": "flatten_nested", "entity": "Account", "field": "items", "block": "ItemBlock",
         "into": "items_count", "strategy": "count"},
        {"type": "split", "from": "Account", "into": ["Account", "AccountDetail"],
         "moved_fields": ["items_count", "note"], "link_field": "account_id"},
    ])


def test_split_then_detail_merged_back(spark):
    steps = [
        {"type": "split", "from": "Invoice", "into": ["Invoice", "InvoiceDetail"], "moved_fields": ["memo", "paid"],
         "link_field": "invoice_id"},
        {"type": "merge", "from": ["Invoice", "InvoiceDetail"], "into": "InvoiceRecord",
         "dropped_link_field": "invoice_id"},
    ]
    _check(spark, steps)


def test_unmapped_then_partition_and_computed(spark):
    steps = [
        {"type": "rename", "entity": "Invoice", "from": "amount", "to": "amount_v2"},
        {"type": "retype", "entity": "Invoice", "field": "paid", "from": "bool", "to": "number"},
        {"type": "unmapped", "entity": "Account", "field": "note"},
        {"type": "computed", "entity": "Invoice", "operation": "sum_fields", "source_fields": ["amount_v2", "paid"],
         "dest_field": "total"},
        {"type": "computed", "entity": "Account", "operation": "concat", "source_fields": ["name", "note"],
         "separator": "/", "dest_field": "label"},
    ]
    _check(spark, steps)
    assert check_preconditions(SCHEMA, log_from_dicts(steps)) == []

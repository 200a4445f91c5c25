"""A harbour: a schema and a log that use every step kind, for property tests and jobs."""

from migrata.spec import Schema, log_from_dicts


def _fields(**kinds):
    """``name="kind"``, ``name="ref Table"``, ``name="nested Block"`` or ``name=[kind, values...]``."""
    out = {"id": {"kind": "id"}}
    for name, k in kinds.items():
        if isinstance(k, list):
            out[name] = {"kind": k[0], "values": k[1:]}
        elif k.startswith("ref "):
            out[name] = {"kind": "ref", "target": k[4:]}
        elif k.startswith("nested "):
            out[name] = {"kind": "nested", "of": k[7:]}
        else:
            out[name] = {"kind": k}
    return {"fields": out}


def _block(**kinds):
    block = _fields(**kinds)
    del block["fields"]["id"]
    return block


SCHEMA = Schema.from_dict({
    "entities": {
        "Port": _fields(town="text", zone=["enum", "north", "south", "inland"], berths="number", tidal="bool", opened="date",
                        alerts="nested AlertBlock"),
        "Carrier": _fields(callsign="text", port_id="ref Port", fleet="number", rank=["enum", "gold", "silver", "plain"],
                           contact="text", notes="richtext", licences=["multi_enum", "reefer", "tank", "bulk", "ro-ro"]),
        "Voyage": _fields(route="text", carrier_id="ref Carrier", cost="number", state=["enum", "planned", "sailing", "moored"],
                          legs="nested LegBlock"),
        "Parcel": _fields(shipper_id="ref Carrier", sort=["enum", "dry", "liquid", "gas"], weight="number", marks="text"),
        "Pilot": _fields(motto="text", grade="number"),
        "PilotLog": _fields(pilot_id="ref Pilot", grade="number", entry="text"),
    },
    "nested_blocks": {
        "AlertBlock": _block(raised="date", cause="text"),
        "LegBlock": _block(stop="text", miles="number", tide=["enum", "ebb", "flood"]),
    },
})

LOG = log_from_dicts([
    {"type": "split", "from": "Voyage", "into": ["Voyage", "VoyageDetail"], "moved_fields": ["cost", "state"],
     "link_field": "voyage_id"},
    {"type": "extract_nested", "entity": "Voyage", "field": "legs", "block": "LegBlock", "new_entity": "Leg",
     "link_field": "voyage_id"},
    {"type": "rename", "entity": "Voyage", "from": "carrier_id", "to": "operator_id"},
    {"type": "merge", "from": ["Pilot", "PilotLog"], "into": "PilotRecord", "dropped_link_field": "pilot_id"},
    {"type": "enum_remap", "entity": "Parcel", "field": "sort", "mapping": {"dry": "D", "liquid": "L", "gas": "G"}},
    {"type": "partition", "entity": "Parcel", "on_field": "sort", "mapping": {"D": "DryParcel", "L": "WetParcel", "G": "GasParcel"}},
    {"type": "flatten_nested", "entity": "Port", "field": "alerts", "block": "AlertBlock", "into": "alerts_count",
     "strategy": "count"},
    {"type": "retype", "entity": "Port", "field": "tidal", "from": "bool", "to": "number"},
    {"type": "retype", "entity": "Port", "field": "berths", "from": "number", "to": "text"},
    {"type": "computed", "entity": "Port", "operation": "sum_fields", "source_fields": ["alerts_count", "tidal"],
     "dest_field": "risk"},
    {"type": "unmapped", "entity": "Carrier", "field": "notes"},
    {"type": "rename", "entity": "Carrier", "from": "contact", "to": "hail"},
    {"type": "denormalize", "entity": "Carrier", "via_field": "port_id", "from_entity": "Port",
     "inlined": [{"source_field": "town", "dest_field": "port_town"}, {"source_field": "zone", "dest_field": "port_zone"}]},
    {"type": "computed", "entity": "Carrier", "operation": "bool_from_enum", "source_field": "rank", "value": "gold",
     "dest_field": "is_gold"},
    {"type": "computed", "entity": "Carrier", "operation": "multiply", "source_fields": ["fleet", "fleet"],
     "dest_field": "fleet_area"},
    {"type": "computed", "entity": "Carrier", "operation": "concat", "source_fields": ["callsign", "hail"], "separator": ": ",
     "dest_field": "banner"},
])

BLOCKS = {b: list(fs) for b, fs in SCHEMA.blocks.items()}

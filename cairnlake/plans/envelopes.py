"""The contract of an observation's envelope, as a schema."""

_TEXT = {"type": "string", "minLength": 1}
_MAYBE = {"type": ["string", "null"]}
_TIME = {"type": ["string", "null"], "format": "date-time"}


def _needs(mode: str, *rules: dict) -> dict:
    return {"if": {"properties": {"mode": {"const": mode}}, "required": ["mode"]}, "then": rules[0] if len(rules) == 1 else {"anyOf": list(rules)}}


# Field names, operations and modes of the envelope's contract.
LABEL = {"type": "object", "required": ["labelId"], "properties": {"labelId": _TEXT, "version": _MAYBE}, "additionalProperties": False}
ENVELOPE = {
    "type": "object",
    "required": ["handoffId", "sourceIdentity", "operation", "acquiredAt", "changeRepresentation"],
    "properties": {
        "handoffId": _TEXT,
        "sourceIdentity": {"type": "object", "required": ["sourceId", "typeCode", "sourceObjectId"], "properties": {"sourceId": _TEXT, "typeCode": _TEXT, "sourceObjectId": _TEXT, "sourceRevision": _MAYBE, "observedAt": _TIME, "validFrom": _TIME, "validTo": _TIME}, "additionalProperties": False},
        "operation": {"type": "string", "enum": ["UPSERT", "DELETE", "TOMBSTONE"]},
        "canonicalPayload": {"type": "object"},
        "acquiredAt": {"type": "string", "format": "date-time"},
        "dataAccessLabels": {"type": "array", "items": {"$ref": "common/label"}, "uniqueItems": True},
        "changeRepresentation": {
            "type": "object",
            "required": ["mode"],
            "properties": {"mode": {"type": "string", "enum": ["FULL_SNAPSHOT", "DELTA_PATCH", "PROPERTY_EVENTS"]}, "baseRevisionRef": _MAYBE, "baseContentHash": _MAYBE, "eventSequence": {"oneOf": [{"type": "integer", "minimum": 0}, _TEXT, {"type": "null"}]}},
            "allOf": [
                _needs("DELTA_PATCH", {"required": ["baseRevisionRef"], "properties": {"baseRevisionRef": _TEXT}}, {"required": ["baseContentHash"], "properties": {"baseContentHash": _TEXT}}),
                _needs("PROPERTY_EVENTS", {"required": ["eventSequence"], "properties": {"eventSequence": {"oneOf": [{"type": "integer", "minimum": 0}, _TEXT]}}}),
            ],
            "additionalProperties": False,
        },
    },
    "allOf": [{"if": {"properties": {"operation": {"const": "UPSERT"}}, "required": ["operation"]}, "then": {"required": ["canonicalPayload"]}}],
    "additionalProperties": True,
}
FILES = {"common/label": LABEL}

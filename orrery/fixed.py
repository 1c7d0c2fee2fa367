"""Texts and formats that conversation records must hold word for word to be read by existing users."""

from __future__ import annotations

import json

# System prompts of the two record pipelines.
SYSTEM_BASE = "You are a geographic reasoning assistant. When asked about spatial relationships between places, first use the geocode tool to look up their coordinates."
SYSTEM_REASON = " Then reason about the coordinates to determine the answer. For each consecutive pair of waypoints (B_i, B_{i+1}), compute the cross product of the vectors from the center A. The sign tells you whether that arc is clockwise or counterclockwise. The overall path is clockwise if every arc is clockwise, counterclockwise if every arc is counterclockwise, and 'neither' if the arcs disagree."
SYSTEM_TOOL = " Then call the cyclic_order tool once for each consecutive pair of waypoints around the center. Combine the per-arc results: if every arc is clockwise, the answer is clockwise; if every arc is counterclockwise, the answer is counterclockwise; otherwise the answer is 'neither'."

# Schemas of the two tools.
_PAIR = {"type": "array", "items": {"type": "number"}, "minItems": 2, "maxItems": 2}
GEOCODE = {
    "type": "function",
    "function": {
        "name": "geocode",
        "description": "Look up geographic coordinates for a list of place names. Returns a mapping from each name to its representative point (latitude, longitude).",
        "parameters": {
            "type": "object",
            "properties": {"place_names": {"type": "array", "items": {"type": "string"}, "description": "List of place names to geocode."}},
            "required": ["place_names"],
        },
    },
}
CYCLIC_ORDER = {
    "type": "function",
    "function": {
        "name": "cyclic_order",
        "description": "Given a center point A and two other points B and C (each as [longitude, latitude]), determine whether the arc from B to C around A is clockwise or counterclockwise. Returns one of 'clockwise' or 'counterclockwise'.",
        "parameters": {
            "type": "object",
            "properties": {
                "center": _PAIR | {"description": "Center point [longitude, latitude]."},
                "point_b": _PAIR | {"description": "First peripheral point [longitude, latitude]."},
                "point_c": _PAIR | {"description": "Second peripheral point [longitude, latitude]."},
            },
            "required": ["center", "point_b", "point_c"],
        },
    },
}
TOOLS = {1: json.dumps([GEOCODE]), 2: json.dumps([GEOCODE, CYCLIC_ORDER])}
# How a system message lists the tools where a template takes none.
TOOL_LISTS = {k: "\n\nAvailable tools:\n" + json.dumps(json.loads(v), indent=2) for k, v in TOOLS.items()}

# The wording of reasoning traces and tool turns.
TRACE_HEAD = "Let me compute this from the coordinates.\n"
TRACE_CENTER = "Center (A): {name} at {point}"
TRACE_WAYPOINT = "Waypoint B{i}: {name} at {point}"
TRACE_ARC = "Arc B{i}→B{j} ({b} → {c}): vector A→B{i} = ({bx:.2f}, {by:.2f}), vector A→B{j} = ({cx:.2f}, {cy:.2f}), cross = ({bx:.2f})({cy:.2f}) - ({by:.2f})({cx:.2f}) = {det:.2f} → {label}."
TRACE_END = "All {n} arcs combined: the path is **{label}**."
PREFACE_FIRST = "I have the coordinates. Let me check the arc from {b} to {c} around {a}."
PREFACE_NEXT = "Now checking the arc from {b} to {c} around {a}."
SUMMARY = "The {n} pairwise arcs around {a} are: {labels}. Since {whether}, the overall path is **{label}**."
AGREE, DISAGREE = "they all agree", "they disagree"

# Markers of a tool call in a completion where no others are found.
CALL_OPEN, CALL_CLOSE = "<tool_call>", "</tool_call>"

"""Schemas and fixed values shared by the whole library."""

from __future__ import annotations

# --- fixed values: class codes of a classified cell -------------------------
UNKNOWN, LAND, WATER, UNCERTAIN = 0, 1, 2, 3

# --- fixed values: vocabulary of the planning contracts ----------------------
LAND_USES = (
    "residential",
    "residential_commercial",
    "commercial",
    "industrial",
    "office",
    "public_service",
    "transport",
    "protection",
    "other",
)
EDITABLE_LAND_USES = ("residential", "residential_commercial")
MODES = ("surface", "elevated", "tunnel")
NETWORK_FORMS = {"Normal": "SURFACE", "Elevated": "ELEVATED", "Tunnel": "TUNNEL"}
BACKGROUND_OBJECTS = ("Pathway", "Taxiway", "Runway", "Tram")
BACKGROUND_TRACK_CATEGORIES = ("Tram", "Cargo")
TOKEN_ATTRIBUTES = ("Object", "Category", "Form", "Direction")

# --- fixed values: vertical units to metres ----------------------------------
VERTICAL_FACTORS = {"m": 1.0, "ft": 0.3048, "us-ft": 1200 / 3937}

# --- fixed values: whole-number cell types and their ranges ------------------
INTEGER_RANGES = {
    "uint8": (0, 255),
    "int16": (-32768, 32767),
    "uint16": (0, 65535),
    "int32": (-2147483648, 2147483647),
    "uint32": (0, 4294967295),
}

# --- fixed values: sizes, steps and tolerances -------------------------------
TILE = 256
DENSIFY_DEGREES = 0.001
DENSIFY_METRES = 100.0
ROUNDTRIP_TOLERANCE_M = 1e-8
FOOTPRINT_TOLERANCE_M = 1e-6
COVERAGE_TOLERANCE_M = 1e-9

VERTEX = "struct<x:double,y:double>"
GEOMETRY = f"struct<kind:string,has_z:boolean,parts:array<array<array<{VERTEX}>>>>"
BBOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
EDGE = "struct<part:int,ring:int,seq:int,x1:double,y1:double,x2:double,y2:double>"

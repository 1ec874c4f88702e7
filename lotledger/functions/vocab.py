"""Phrases and short forms that name a known option outright.

Order matters wherever a first hit wins; the tables keep it.
"""

from __future__ import annotations

# Feature phrase -> (checkbox group, label).
FEATURE_SYNONYMS = {
    "electronic stability control": ("security", "Vehicle Stability Control"),
    "front parking radar": ("comfort", "Parking sensor front"),
    "rear parking radar": ("comfort", "Parking sensor rear"),
    "high beam assist": ("security", "Auto High Beam Control"),
    "rearview camera": ("comfort", "Rear Camera"),
    "tire pressure": ("comfort", "Tyre pressure warning system"),
    "usb interface": ("infotainment", "USB & Auxiliary Cable"),
    "bluetooth": ("infotainment", "Bluetooth system"),
    "driving mode selection": ("comfort", "Drive Modes"),
    "smart display": ("infotainment", "Touch Screen"),
    "multifunctional steering wheel": ("comfort", "Steering Switches"),
    "one-key start": ("comfort", "Push Start"),
}

FEATURE_ACRONYMS = {
    "tpms": ("comfort", "Tyre pressure warning system"),
    "esc": ("security", "Vehicle Stability Control"),
    "vsc": ("security", "Vehicle Stability Control"),
    "esp": ("security", "Vehicle Stability Control"),
    "vdc": ("security", "Vehicle Stability Control"),
}

# Specification label -> parent specification.
SPEC_LABEL_HINTS = {
    "transmission": "Transmission",
    "gearbox": "Transmission",
    "fuel": "Fuel Type",
    "fuel type": "Fuel Type",
    "engine type": "Fuel Type",
    "drive": "Drive Type",
    "drive type": "Drive Type",
    "drivetrain": "Drive Type",
    "seats": "Seats",
    "seating": "Seats",
    "seating capacity": "Seats",
    "no of seats": "Seats",
    "doors": "Doors",
    "no of doors": "Doors",
    "cylinders": "Cylinders",
    "no of cylinders": "Cylinders",
    "engine cylinders": "Cylinders",
    "body": "Body Type",
    "body type": "Body Type",
    "body style": "Body Type",
    "colour": "Color",
    "color": "Color",
    "exterior color": "Color",
    "exterior colour": "Color",
    "body color": "Color",
    "paint": "Color",
    "interior color": "Interior Color",
    "interior colour": "Interior Color",
    "upholstery": "Interior Color",
    "trim color": "Interior Color",
    "steering": "Steering Side",
    "steering side": "Steering Side",
    "steering position": "Steering Side",
    "wheel size": "Wheel Size",
    "wheels": "Wheel Size",
    "rim size": "Wheel Size",
    "tyre size": "Wheel Size",
    "tire size": "Wheel Size",
    "regional specification": "Regional Specification",
    "region": "Regional Specification",
    "specs": "Regional Specification",
    "regional specs": "Regional Specification",
}

NUMERIC_PARENTS = ("Seats", "Cylinders", "Doors", "Wheel Size")

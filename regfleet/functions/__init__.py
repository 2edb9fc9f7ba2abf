"""Row rules as ``Column -> Column`` expressions; no Python runs per row."""

from regfleet.functions.addresses import (
    apply_offset,
    base_register,
    bits_address,
    decimal_part,
    expand_str_address,
    expand_str_type,
    is_negative,
    register_count,
    valid_address,
    valid_register,
)
from regfleet.functions.codes import action_code, default_register_type, known_register_type, register_code
from regfleet.functions.datatypes import normalize_type, valid_type
from regfleet.functions.naming import definition_slug, tag_base
from regfleet.functions.numbers import coefficient_a, fixed6, parse_number, scale_exponent
from regfleet.functions.text import strip, text

__all__ = [
    "action_code", "apply_offset", "base_register", "bits_address", "coefficient_a", "decimal_part",
    "default_register_type", "definition_slug", "expand_str_address", "expand_str_type", "fixed6",
    "is_negative", "known_register_type", "normalize_type", "parse_number", "register_code",
    "register_count", "scale_exponent", "strip", "tag_base", "text",
    "valid_address", "valid_register", "valid_type",
]

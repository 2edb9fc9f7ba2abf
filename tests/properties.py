"""What results of the order-dependent rules must fulfil, for comparison with any way of getting them."""

from bisect import bisect_left


def tag_faults(rows):
    """Lines whose tag is wrong, of (line, name, given, base, tag) of one map.

    A given tag stays; a row without name and tag has none. Any other row has its base, alone or with a number, in a
    spelling that no earlier line has, while earlier lines have all smaller numbers.
    """
    first = {}
    for line, _, _, _, tag in rows:
        if tag:
            first[tag] = min(line, first.get(tag, line))

    def right(line, name, given, base, tag):
        if given or not name:
            return tag == given
        spellings = iter([base])
        number = 0
        while (spelling := next(spellings, f"{base}_{number}")) != tag:
            if first.get(spelling, line) >= line:
                return False
            number += 1
        return first[tag] == line

    return [row[0] for row in rows if not right(*row)]


def repeats(rows):
    """(line, first line) of the values that an earlier line has, of (line, value)."""
    lines = {}
    for line, value in rows:
        if value:
            lines.setdefault(value, []).append(line)
    return {(line, min(found)) for found in lines.values() for line in found if line > min(found)}


def shared_registers(rows):
    """(later, earlier) lines that share registers, of (line, start, end, is_bits); BITS of one register may."""
    cuts = sorted({x for _, start, end, _ in rows for x in (start, end + 1)})
    held = [(line, bits, set(range(bisect_left(cuts, start), bisect_left(cuts, end + 1)))) for line, start, end, bits in rows]
    return {(a, b) for a, a_bits, x in held for b, b_bits, y in held if a > b and x & y and not (a_bits and b_bits)}

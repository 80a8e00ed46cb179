"""Column functions: names, tags, boxes, small numerical formulas."""

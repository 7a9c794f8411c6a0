"""Column expressions: text clean-up, numbers, JSON, time, boxes, joins."""

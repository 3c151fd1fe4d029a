"""From text to plans, and from plans to text."""

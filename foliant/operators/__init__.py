"""Relational operators over rectangles, intervals and graphs."""

"""Operators over documents, pages, boxes, glyphs, paragraphs, services and drawing operators."""

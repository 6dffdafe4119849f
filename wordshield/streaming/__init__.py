"""Scanning of message streams."""

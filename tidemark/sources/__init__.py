"""Readers of agent logs, each giving rows of tidemark.schema.RAW_EVENT."""

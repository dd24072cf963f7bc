"""Stateful operators over streams of heartbeats, findings, reports and logs."""

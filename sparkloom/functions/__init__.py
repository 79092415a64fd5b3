"""Part of the sparkloom package."""

"""Part of fusionweft."""

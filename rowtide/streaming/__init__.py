"""Long-running loops: conversion and ingest."""

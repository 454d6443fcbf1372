"""colloquy.plans"""
